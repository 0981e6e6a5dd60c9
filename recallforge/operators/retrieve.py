"""Lists of hits: corpus statistics, top-k, source caps, contexts, fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallforge.functions.wordbatch import TermBatches


#: Rows, and bytes of texts, whose terms are counted at once.
ROWS, BYTES = 2048, 4 << 20


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of bounded size, of one text at least."""
    ends, a = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while a < len(texts):
        b = min(a + ROWS, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BYTES, "right"))))
        yield texts.slice(a, b - a)
        a = b


def bm25_stats(memories: DataFrame) -> DataFrame:
    """(term, df, doc_count, avg_len) over all rows (id, content); terms are stemmed, and counted by runs of texts."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TermBatches()
        for batch in batches:
            for part in slices(batch.column("content")):
                found, numbers, bounds = encoder.encode(part.to_pylist())
                of = np.repeat(np.arange(len(part)), np.diff(bounds))
                df = np.bincount(np.unique(of * max(len(found), 1) + numbers) % max(len(found), 1), minlength=len(found))
                # totals ride along as a term of their own (null), so the texts are read once
                columns = pa.array([*found, None], pa.string()), pa.array([*df.tolist(), len(part)], pa.int64()), pa.array([*[0] * len(found), len(numbers)], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns], names=["term", "df", "total"])

    each = memories.select("content").mapInArrow(made, "term string, df long, total long")
    counted = each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    sums = counted.filter("term is null").selectExpr("df doc_count", "total / df avg_len")
    return counted.filter("term is not null").select("term", "df").crossJoin(F.broadcast(sums))  # one row of totals


def top(scored: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "id") -> DataFrame:
    """The ``k`` best of each query, ties by id; planned as two-phase group limits."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cap_sources(ranked: DataFrame, most: int = 2, score: str = "score") -> DataFrame:
    """At most ``most`` of each query and source; rows without a source are not capped."""
    w = Window.partitionBy("query_id", "source").orderBy(F.col(score).desc(), F.col("id"))
    return ranked.withColumn("n", F.row_number().over(w)).filter(F.col("source").isNull() | (F.col("n") <= most)).drop("n")


def build_context(hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, context): a heading and a line for each hit in the order of ``rank``; empty for ``queries`` without hits."""
    line = F.format_string("- [%s score=%.3f confidence=%.2f] %s\n", "memory_type", F.round("score", 3), "confidence", F.coalesce("content", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    out = hits.groupBy("query_id").agg(F.concat(F.lit("# Agent Memory\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "")).alias("context"))
    if queries is None:
        return out
    return queries.select("query_id").distinct().join(out, "query_id", "left").select("query_id", F.coalesce("context", F.lit("")).alias("context"))


def fuse(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The union of two candidate lists with the best score of each memory, cut to ``k``."""
    both = a.select("query_id", "id", "score").unionByName(b.select("query_id", "id", "score"))
    return top(both.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)
