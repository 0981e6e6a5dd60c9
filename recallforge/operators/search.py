"""Hybrid search: a stated set of queries against all memories, in blocks of queries.

A block of queries, of bounded size, goes to all tasks with the corpus statistics of its own terms.  Each task scores its
memories against the block from sparse counts and keeps only what can still be among the best of each query, so no term
and no text is shuffled.  Two scans are made for each block: statistics, then scores.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, DoubleType, IntegerType, StructField, StructType

from recallforge.functions.embedding import EmbeddingProvider, HashEmbedding, normalised, token_hash
from recallforge.functions.entities import held_entities, text_names
from recallforge.functions.normal import KIND_FACTORS, OTHER_KIND, kind_factor, turn_index
from recallforge.functions.text import TermNumbers, stemmed
from recallforge.functions.wordbatch import TermBatches, word_numbers
from recallforge.operators.retrieve import cap_sources, top
from recallforge.sources.index import K1, Asked, B, TextIndex
from recallforge.sources.shared import Scratch, materialize

# Weights of the signals with hashed and with external embeddings.
HASHED = {"density": 0.32, "bm25": 0.13, "entity": 0.15, "speaker": 0.05, "cosine": 0.02, "importance": 0.03, "kind": 0.05, "prefix": 0.25, "temporal": 0.1}
EXTERNAL = {"density": 0.22, "bm25": 0.09, "entity": 0.22, "speaker": 0.06, "cosine": 0.25, "importance": 0.04, "kind": 0.12, "prefix": 0.25, "temporal": 0.1}
BM25_ONLY = {"bm25": 1.0}
SIGNALS = ("cosine", "density", "bm25", "entity", "temporal", "speaker", "prefix")
#: Bytes of query texts and queries in a block, memories and bytes of their texts that are scored at once, and pairs of both.
BLOCK_BYTES, MOST_QUERIES, ROWS, TEXT_BYTES, CELLS = 2 << 20, 2048, 512, 2 << 20, 4 << 20


@dataclass
class Search:
    """How to score: the weights, an embedding (none: hashed), decimals that scores are rounded to, sources' cap."""

    limit: int = 8
    weights: dict[str, float] | None = None
    provider: EmbeddingProvider | None = None
    digits: int = 6
    per_source: int | None = 2
    matches_only: bool = False  # leave out memories that share no term with the query

    def __post_init__(self) -> None:
        self.weights = self.weights or (EXTERNAL if self.provider else HASHED)
        if self.limit < 1:
            raise ValueError("limit must be 1 at least")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores where they come in fewer partitions, as from one small file; large inputs stay as they are."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def prepared(memories: DataFrame) -> DataFrame:
    """(id, namespace, source, content, importance, kind, turn, speaker, entities) of memories; what is missing has defaults."""
    have = memories.columns
    meta = F.col("metadata") if "metadata" in have else F.create_map().cast("map<string,string>")

    def column(name: str, other: Column) -> Column:
        return F.coalesce(name, other) if name in have else other

    source = F.col("source_event_id") if "source_event_id" in have else F.col("source") if "source" in have else F.lit(None)
    return memories.select(
        "id", column("namespace", F.lit("default")).alias("namespace"), source.cast("string").alias("source"), F.coalesce("content", F.lit("")).alias("content"),
        column("importance", F.lit(0.5)).cast("double").alias("importance"), kind_factor(F.coalesce(meta["memory_kind"], F.lit(""))).cast("double").alias("kind"),
        turn_index(source.cast("string")).alias("turn"), F.lower(F.coalesce(meta["speaker"], F.lit(""))).alias("speaker"), held_entities(meta).alias("entities"),
    )


def asked(queries: DataFrame) -> DataFrame:
    """(query_id, namespace, text) of queries; the namespace is ``default`` where there is none."""
    namespace = F.coalesce("namespace", F.lit("default")) if "namespace" in queries.columns else F.lit("default")
    return queries.select("query_id", namespace.alias("namespace"), F.coalesce("text", F.lit("")).alias("text"))


def blocks(queries: DataFrame, most: int | None = None) -> Iterator[list]:
    """The queries in blocks of about ``most`` bytes of text and ``MOST_QUERIES`` queries; the driver holds one block at a time.

    Several blocks are laid out by block once, so each is read alone.
    """
    rows, most = asked(queries), most or BLOCK_BYTES
    size = rows.agg(F.sum(F.octet_length("text") + 64).alias("bytes"), F.count("*").alias("n")).first()
    n = max(1, -(-int(size.bytes or 0) // most), -(-size.n // MOST_QUERIES))
    with Scratch(queries.sparkSession) as scratch:
        if n > 1:
            path = scratch.path("queries")
            dealt = rows.withColumn("block", F.pmod(F.xxhash64("query_id", "text"), F.lit(n)).cast("int"))
            dealt.write.partitionBy("block").parquet(path)
            rows = queries.sparkSession.read.schema(dealt.schema).parquet(path)
        for k in range(n):
            yield sorted((rows if n == 1 else rows.filter(F.col("block") == k).drop("block")).collect())


class Query(NamedTuple):
    """A query as a row of ``asked``."""

    query_id: object
    namespace: str
    text: str


class Block:
    """Queries as sparse counts over their own terms and entities."""

    def __init__(self, queries: list, plan: Search):
        self.plan, self.ids = plan, [q.query_id for q in queries]
        self.namespaces = np.array([q.namespace for q in queries], object)
        self.low = [q.text.lower() for q in queries]
        bags = [stemmed(q.text) for q in queries]
        self.terms, self.of_term = self._index([set(b) for b in bags])
        self.entities, self.of_entity = self._index([text_names(q.text) if plan.weights.get("entity") else () for q in queries])
        self.sizes = np.array([len(set(b)) for b in bags], float)
        self.vectors = None
        if plan.weights.get("cosine"):
            self.vectors = np.array([plan.provider.embed(q.text) for q in queries]) if plan.provider else HashEmbedding().embed_tokens(bags)
        # terms by what they begin with, for tokens that are the beginning of a term
        self.begins: dict[str, list[int]] = defaultdict(list)
        if plan.weights.get("prefix"):
            for t, k in self.terms.items():
                if len(t.encode()) >= 4:
                    for n in range(1, len(t)):
                        if len(t[:n].encode()) >= 4:
                            self.begins[t[:n]].append(k)
        self.related: dict[str, list[int]] = {}
        self.numbers, self.batches = TermNumbers(self.terms), TermBatches()

    @staticmethod
    def _index(sets: list) -> tuple[dict[str, int], tuple[np.ndarray, np.ndarray]]:
        """Numbers of the keys of all sets; where each key's sets begin, and the sets by key."""
        by: dict[str, list[int]] = defaultdict(list)
        for q, found in enumerate(sets):
            for t in found:
                by[t].append(q)
        order = sorted(by)
        return {t: k for k, t in enumerate(order)}, (np.cumsum([0, *(len(by[t]) for t in order)]), np.array([q for t in order for q in by[t]], np.int64))

    def near(self, token: str) -> list[int]:
        """Terms that begin with ``token`` or that it begins with, both of four bytes at least; not itself."""
        if token[:2] not in self.numbers.begins and token[:1] not in self.numbers.begins and len(token) > 1:
            return []
        if token not in self.related:
            if len(self.related) > 50_000:
                self.related.clear()
            found = []
            if len(token.encode()) >= 4:
                found = [*self.begins.get(token, ()), *(self.terms[token[:n]] for n in range(1, len(token)) if token[:n] in self.terms and len(token[:n].encode()) >= 4)]
            self.related[token] = found
        return self.related[token]

    def spread(self, rows: np.ndarray, keys: np.ndarray, values: np.ndarray, of: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
        """(row, query) sums of values of (row, key), for all queries that have the key; some ``CELLS`` of them at once."""
        out = np.zeros(n * len(self.ids))
        starts, queries = of
        sizes = np.diff(starts)[keys] if len(keys) else np.empty(0, np.int64)
        ends = np.cumsum(sizes)
        edges = np.unique([0, *np.searchsorted(ends, np.arange(CELLS, ends[-1] if len(ends) else 0, CELLS), "right"), len(keys)])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = sizes[a:b]
            at = np.repeat(starts[keys[a:b]] - np.cumsum(own) + own, own) + np.arange(own.sum())
            out += np.bincount(np.repeat(rows[a:b] * len(self.ids), own) + queries[at], np.repeat(values[a:b], own), minlength=len(out))
        return out.reshape(n, len(self.ids))


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch with ``content`` in runs of up to ``ROWS`` rows and about ``TEXT_BYTES`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column("content")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(sizes) // TEXT_BYTES << 32) + np.arange(len(sizes)) // ROWS
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def counted_pairs(numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number, how often) of the numbers of texts that lie between bounds, in order; negative numbers are left out."""
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keys = np.sort((of << 32 | numbers)[numbers >= 0])
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first] >> 32, keys[first] & 0xFFFFFFFF, np.diff(np.r_[first, len(keys)])


def known_numbers(words: list[str], of: np.ndarray, numbers: TermNumbers) -> np.ndarray:
    """The vocabulary's numbers of texts that are numbers ``of`` distinct words."""
    return np.array([numbers.number(w) for w in words], np.int64)[of] if words else of


def statistics(memories: DataFrame, block: Block) -> dict[str, tuple[int, float, dict[int, int]]]:
    """By namespace: number of memories, mean number of tokens, documents that each term of the block is in."""
    sent = memories.sparkSession.sparkContext.broadcast((block.terms, set(block.namespaces)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, wanted = sent.value
        numbers = TermNumbers(terms)
        n, total, df = Counter(), Counter(), Counter()
        for whole in batches:
            for batch in pieces(whole):
                held = [x for x in zip(batch.column("namespace").to_pylist(), batch.column("content").to_pylist(), strict=True) if x[0] in wanted]
                if not held:
                    continue
                words, of, bounds = word_numbers([text for _, text in held])
                space, spaces = pd.factorize(np.array([ns for ns, _ in held], object))
                n.update(dict(zip(spaces, np.bincount(space).tolist(), strict=True)))
                total.update(dict(zip(spaces, np.bincount(space, np.diff(bounds)).astype(np.int64).tolist(), strict=True)))
                doc, k, _ = counted_pairs(known_numbers(words, of, numbers), bounds)
                pairs, counts = np.unique(space[doc] << 32 | k, return_counts=True)
                df.update({(spaces[x >> 32], x & 0xFFFFFFFF): c for x, c in zip(pairs.tolist(), counts.tolist(), strict=True)})
        rows = [*((ns, -1, n[ns], total[ns]) for ns in n), *((ns, k, c, 0) for (ns, k), c in df.items())]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["namespace", "k", "n", "total"])

    found = memories.select("namespace", "content").mapInArrow(counted, "namespace string, k int, n long, total long")
    out: dict[str, tuple[int, float, dict[int, int]]] = {}
    for r in found.groupBy("namespace", "k").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # the block's own terms
        n, mean, df = out.get(r.namespace, (0, 0.0, {}))
        if r.k < 0:
            n, mean = r.n, r.total / r.n
        else:
            df[r.k] = r.n
        out[r.namespace] = (n, mean, df)
    return out


def signals(batch: pd.DataFrame, block: Block, stats: dict) -> dict[str, np.ndarray]:
    """Every signal of the memories of a batch with all queries of a block, as (memory, query) arrays."""
    n, weights = len(batch), block.plan.weights
    texts, none = batch["content"].tolist(), np.zeros((n, len(block.ids)))
    if any(weights.get(s) for s in ("density", "prefix", "cosine")):  # these look at all tokens of a memory
        terms, numbers, bounds = block.batches.encode(texts)
        doc, term, count = counted_pairs(numbers, bounds)
        known = np.array([block.terms.get(t, -1) for t in terms], np.int64)[term] if terms else term
        rows, keys, tf = doc[known >= 0], known[known >= 0], count[known >= 0]
    else:
        words, numbers, bounds = word_numbers(texts)
        rows, keys, tf = counted_pairs(known_numbers(words, numbers, block.numbers), bounds)
    out = {}
    if weights.get("bm25"):
        length = np.diff(bounds)
        idf, mean = np.zeros(len(rows)), np.ones(len(rows))
        for ns in set(batch["namespace"]):
            own = (batch["namespace"].to_numpy() == ns)[rows] if len(rows) else np.empty(0, bool)
            count_, avg, df = stats.get(ns, (0, 0.0, {}))
            distinct, at = np.unique(keys[own], return_inverse=True)
            d = np.array([df.get(k, 0) for k in distinct.tolist()], float)[at]
            idf[own], mean[own] = np.log((count_ - d + 0.5) / (d + 0.5) + 1.0), max(avg, 1.0)
        out["bm25"] = block.spread(rows, keys, idf * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * length[rows] / mean)), block.of_term, n)
    if block.plan.matches_only or weights.get("density") or weights.get("prefix"):
        shared = out["shared"] = block.spread(rows, keys, np.ones(len(rows)), block.of_term, n)
    if weights.get("density"):
        union = np.bincount(doc, minlength=n).astype(float)[:, None] + block.sizes[None, :] - shared
        out["density"] = np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)
    if weights.get("prefix"):
        near, most = [block.near(t) for t in terms], max(len(block.terms), 1)
        starts = np.cumsum([0, *map(len, near)])
        sizes = np.diff(starts)[term] if len(term) else term
        at = np.repeat(starts[term] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        half = np.setdiff1d(np.repeat(doc * most, sizes) + np.array([k for ks in near for k in ks], np.int64)[at], rows * most + keys)
        out["prefix"] = (shared + block.spread(half // most, half % most, np.full(len(half), 0.5), block.of_term, n)) / np.maximum(block.sizes, 1.0)[None, :]
    if weights.get("cosine"):
        if block.plan.provider:
            vectors = np.array([block.plan.provider.embed(t) for t in texts])
        else:
            size, h = block.vectors.shape[1], np.array([token_hash(t) for t in terms], np.int64)[term] if terms else term
            vectors = normalised(np.bincount(doc * size + h % size, count * (1.0 - 2.0 * (h & 1)), n * size).reshape(n, size))
        out["cosine"] = np.maximum(vectors.reshape(n, -1) @ block.vectors.T, 0.0) if vectors.size and block.vectors.size else none
    if weights.get("entity"):
        held = [(i, block.entities[e]) for i, found in enumerate(batch["entities"]) for e in set(found) if e in block.entities]
        i, k = (np.array(x) for x in zip(*held, strict=True)) if held else (np.empty(0, int),) * 2
        out["entity"] = np.minimum(0.5 * block.spread(i, k, np.ones(len(i)), block.of_entity, n), 1.2)
        turn = batch["turn"].to_numpy(float)
        out["temporal"] = np.where(out["entity"] > 0.05, np.nan_to_num(1.0 / (1.0 + turn))[:, None], 0.0)
    if weights.get("speaker"):
        said = {s: np.array([float(s != "" and s in low) for low in block.low]) for s in set(batch["speaker"])}
        out["speaker"] = np.array([said[s] for s in batch["speaker"]])
    return out


def best(rows: pd.DataFrame, plan: Search) -> pd.DataFrame:
    """What is left of scored rows (q, id, source, score, ...) of each query: sources capped, then cut to the limit."""

    def place(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        new = np.zeros(len(order), bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        new[:1] = True
        starts = np.flatnonzero(new)
        at = np.empty(len(order), int)
        at[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        return at

    if plan.per_source is not None and len(rows):
        source = pd.factorize(rows["source"])[0]
        order = np.lexsort((rows["id"].to_numpy(), -rows["score"].to_numpy(), source, rows["q"].to_numpy()))
        rows = rows[(place([rows["q"].to_numpy(), source], order) < plan.per_source) | (source < 0)]
    if len(rows):
        order = np.lexsort((rows["id"].to_numpy(), -rows["score"].to_numpy(), rows["q"].to_numpy()))
        rows = rows[place([rows["q"].to_numpy()], order) < plan.limit]
    return rows


def _held(batches: Iterable[pa.RecordBatch], block: Block, stats: dict) -> pd.DataFrame | None:
    """What may be among the best of each query of a block, of the memories of all batches."""
    plan, held, least = block.plan, None, np.full(len(block.ids), -np.inf)
    names = [s for s in SIGNALS if plan.weights.get(s)]
    for whole in batches:
        for piece in pieces(whole):
            batch = piece.to_pandas()
            found = signals(batch, block, stats)
            total = sum(plan.weights[s] * found[s] for s in names)
            for s in ("importance", "kind"):
                total = total + plan.weights.get(s, 0.0) * batch[s].to_numpy()[:, None]
            total = np.round(total, plan.digits)
            ok = (total >= least[None, :]) & (batch["namespace"].to_numpy()[:, None] == block.namespaces[None, :])
            if plan.matches_only:
                ok &= found["shared"] > 0
            i, q = np.nonzero(ok)
            new = pd.DataFrame({"q": q, "id": batch["id"].to_numpy()[i], "source": batch["source"].to_numpy()[i], "score": total[i, q], **{s: found[s][i, q] for s in names}})
            held = best(new if held is None else pd.concat([held, new], ignore_index=True), plan)
            full = held.groupby("q")["score"].agg(["size", "min"])
            full = full[full["size"] >= plan.limit]
            least[full.index.to_numpy()] = full["min"].to_numpy()
    return held


def score_block(memories: DataFrame, queries: list, plan: Search, query_type: DataType, stats: dict | None = None) -> DataFrame:
    """(query_id, id, source, score, signals): of every task what may be among the best of a query.

    ``stats`` are those of all memories, where ``memories`` are some of them.
    """
    block = Block(queries, plan)
    stats = statistics(memories, block) if stats is None else stats
    # with the providers of users, whose classes need not be importable where tasks run
    sent = memories.sparkSession.sparkContext.broadcast(cloudpickle.dumps((block, stats)))
    names = [s for s in SIGNALS if plan.weights.get(s)]
    wanted = memories.filter(F.col("namespace").isin(sorted(set(block.namespaces))))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = cloudpickle.loads(sent.value)
        held = _held(batches, own, known)
        if held is not None and len(held):
            out = held.assign(query_id=[own.ids[q] for q in held["q"]])[["query_id", "id", "source", "score", *names]]
            yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

    spark_schema = StructType([StructField("query_id", query_type), memories.schema["id"], memories.schema["source"], *(StructField(c, DoubleType()) for c in ("score", *names))])
    schema = to_arrow_schema(spark_schema)
    return wanted.mapInArrow(scored, spark_schema)


#: Namespaces up to this number are all searched by blocks; the most memories, bytes of their texts and queries of a namespace that
#: is searched in one place.
FEW_SPACES, APART, APART_BYTES, APART_QUERIES = 16, 4096, 8 << 20, 256


def _crowded(memories: DataFrame, queries: DataFrame) -> DataFrame | None:
    """(namespace) of the namespaces that are too large to be searched in one place; none if there are only a few in all.

    There is at most one for each ``APART`` memories or ``APART_QUERIES`` queries, so they are broadcast.
    """
    asked_ = asked(queries).groupBy("namespace").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    if asked_.limit(FEW_SPACES + 1).count() <= FEW_SPACES:
        return None
    namespace = F.coalesce("namespace", F.lit("default")).alias("namespace")
    held = memories.groupBy(namespace).agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))
    return held.filter(f"n > {APART} or bytes > {APART_BYTES}").select("namespace").unionByName(asked_.filter(f"n > {APART_QUERIES} or bytes > {APART_BYTES}").select("namespace")).distinct()


def _by_namespace(memories: DataFrame, queries: DataFrame, plan: Search, crowded: DataFrame) -> DataFrame:
    """(query_id, id, source, score, signals, rank) of the queries whose namespaces are not ``crowded``.

    Each namespace's memories and queries meet in one place, and small namespaces are scored several at once; so the work is
    that of the pairs within namespaces, however many of these there are.
    """
    asked_ = asked(queries).join(F.broadcast(crowded), "namespace", "left_anti")
    rows = prepared(memories).join(F.broadcast(crowded), "namespace", "left_anti")
    names = [s for s in SIGNALS if plan.weights.get(s)]
    query_type = queries.schema["query_id"].dataType
    spark_schema = StructType([StructField("query_id", query_type), memories.schema["id"], rows.schema["source"], *(StructField(c, DoubleType()) for c in ("score", *names)), StructField("rank", IntegerType())])
    schema, sent = to_arrow_schema(spark_schema), memories.sparkSession.sparkContext.broadcast(cloudpickle.dumps(plan))

    def results(part: pa.Table, plan: Search) -> Iterator[pa.RecordBatch]:
        side = part.column("side").to_numpy()
        of_queries, of_memories = part.filter(pa.array(side == 0)), part.filter(pa.array(side == 1))
        if not of_queries.num_rows or not of_memories.num_rows:
            return
        block = Block([Query(*x) for x in zip(*(of_queries.column(c).to_pylist() for c in ("query_id", "namespace", "content")), strict=True)], plan)
        wanted, lengths, df = set(block.namespaces), defaultdict(list), defaultdict(Counter)
        spaces = of_memories.column("namespace").to_pylist()
        of_memories = of_memories.filter(pa.array([ns in wanted for ns in spaces]))
        for ns, text in zip(of_memories.column("namespace").to_pylist(), of_memories.column("content").to_pylist(), strict=True):
            length, found = block.numbers.count(text)
            lengths[ns].append(length)
            df[ns].update(found.keys())
        stats = {ns: (len(n), sum(n) / len(n), df[ns]) for ns, n in lengths.items()}
        held = _held(of_memories.combine_chunks().to_batches(), block, stats)
        if held is not None and len(held):
            order = np.lexsort((held["id"].to_numpy(), -held["score"].to_numpy(), held["q"].to_numpy()))
            held = held.iloc[order]
            out = held.assign(query_id=[block.ids[q] for q in held["q"]], rank=held.groupby("q").cumcount() + 1)[["query_id", "id", "source", "score", *names, "rank"]]
            yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, held = cloudpickle.loads(sent.value), None
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                part = pa.Table.from_batches([whole.slice(a, ROWS)])
                held = part if held is None else pa.concat_tables([held, part])
                if held.num_rows < ROWS:
                    continue
                # a namespace is scored when all of it is there
                spaces = held.column("namespace")
                cut = pc.index(spaces, spaces[-1]).as_py()
                if cut:
                    yield from results(held.slice(0, cut), plan)
                    held = held.slice(cut)
        if held is not None:
            yield from results(held, plan)

    both = rows.withColumn("side", F.lit(1)).unionByName(asked_.select("query_id", "namespace", F.col("text").alias("content"), F.lit(0).alias("side")), allowMissingColumns=True)
    return both.repartition("namespace").sortWithinPartitions("namespace").mapInArrow(stream, spark_schema)


def search(memories: DataFrame, queries: DataFrame, plan: Search | None = None, index: TextIndex | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, id, source, score, signals, rank): the best memories of each query in its namespace.

    ``memories`` are those that the query may see (see ``log.visible``).  Ties go by id; a null source is not capped.
    Queries without text, and namespaces without memories, get what the other signals give, or nothing.  With an ``index``
    of the same memories only those are read and scored that may be among the best, with the same result.  ``prepare``
    adds what memories are scored by, as ``entities.enrich`` does, to those that are.  Of many namespaces each is searched in
    one place, but for the large ones.
    """
    plan = plan or Search()
    prepare = prepare or (lambda rows: rows)
    if index is None and "namespace" in memories.columns and "namespace" in queries.columns and (crowded := _crowded(memories, queries)) is not None:
        with Scratch(memories.sparkSession) as scratch:
            crowded = [r.namespace for r in scratch.table(crowded, "crowded").collect()]  # few, see there
        large = memories.sparkSession.createDataFrame([(ns,) for ns in crowded], "namespace string")
        apart = _by_namespace(prepare(memories), queries, plan, large)
        if not crowded:
            return apart
        namespace = F.coalesce("namespace", F.lit("default"))
        rest, theirs = (rows.filter(namespace.isin(crowded)) for rows in (memories, queries))
        return _by_blocks(rest, theirs, plan, None, prepare).select(*apart.columns).unionByName(apart)
    return _by_blocks(memories, queries, plan, index, prepare)


def _by_blocks(memories: DataFrame, queries: DataFrame, plan: Search, index: TextIndex | None, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As ``search``, each block of queries against all memories."""
    out, query_type = None, queries.schema["query_id"].dataType
    for block in blocks(queries):
        if block:
            if index is not None and plan.provider is None:
                part = _through_index(index, memories, block, plan, query_type, prepare)
            else:
                part = score_block(prepared(prepare(spread(memories))), block, plan, query_type)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = score_block(prepared(prepare(memories.limit(0))), [], plan, query_type)
    return top(cap_sources(out, plan.per_source) if plan.per_source is not None else out, plan.limit)


#: Ids up to this number are broadcast, some 20 bytes each; more are joined.
FEW_IDS = 200_000


def _picked(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The memories whose ids are in a written table (id)."""
    ids = ids.select("id").distinct()
    return memories.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "id", "left_semi")


def _through_index(index: TextIndex, memories: DataFrame, queries: list, plan: Search, query_type: DataType, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As ``score_block`` of all memories, from those that the index doesn't exclude.

    The best by terms are scored in full, which gives each query a threshold; every memory whose terms, with all that the
    other signals can add, reach the threshold is scored, too.  Queries that get no threshold, as those with few matches,
    are scored against all memories.
    """
    block, w = Block(queries, plan), plan.weights
    asked = Asked([q.namespace for q in queries], [sorted(set(stemmed(q.text))) for q in queries], w.get("bm25", 0.0), w.get("density", 0.0) + 0.5 * w.get("prefix", 0.0))
    with Scratch(index.spark) as scratch:
        found = index.search(asked, scratch)
        stats = {ns: (s.count, s.mean, {block.terms[t]: s.df[k] for t, k in asked.numbers.items() if k in s.df}) for ns, s in found.stats.items()}
        if plan.matches_only and set(w) == {"bm25"}:
            best_ = materialize(_named(found.best(plan.limit if plan.per_source is None else SURE * plan.limit, scratch, plan.digits).filter("q >= 0"), queries, query_type), "found")
            if plan.per_source is None:
                own = prepared(_picked(memories, best_)).select("id", "source")
                return best_.selectExpr("query_id", "id", "value score", "value bm25").join(F.broadcast(own) if own.count() <= FEW_IDS else own, "id").select("query_id", "id", "source", "score", "bm25")
        first = scratch.table(found.best(SURE * plan.limit, scratch).filter("q >= 0").select("q", "id"), "first")
        rated = scratch.table(score_block(prepared(prepare(_picked(memories, first))), queries, plan, query_type, stats), "rated")
        kept = top(cap_sources(rated, plan.per_source) if plan.per_source is not None else rated, plan.limit)
        least = {r.query_id: r.least for r in kept.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= plan.limit).collect()}  # one row a query
        bound = _others(memories, plan)
        near = found.above([least[q.query_id] - bound if q.query_id in least else np.inf for q in queries])
        # what was rated is not scored again
        more = scratch.table(near.select("id").distinct().join(first.select("id").distinct(), "id", "left_anti"), "more")
        out = rated.unionByName(score_block(prepared(prepare(_picked(memories, more))), queries, plan, query_type, stats))
        out = materialize(out, "scored")
        open_ = [q for q in queries if q.query_id not in least or least[q.query_id] - bound <= 0]
        if open_:
            known = [q.query_id for q in open_]
            whole = materialize(score_block(prepared(prepare(spread(memories))), open_, plan, query_type), "scored")
            out = out.filter(~F.col("query_id").isin(known)).unionByName(whole)
        return out


#: Times the limit, how many memories are scored to get a threshold.
SURE = 4


def _others(memories: DataFrame, plan: Search) -> float:
    """What all signals but those of shared terms can add to a score at most."""
    w = plan.weights
    # a query's terms that a memory shares give a whole point of the prefix signal, others half of one at most
    fixed = 0.5 * w.get("prefix", 0.0) + 1.2 * w.get("entity", 0.0) + w.get("cosine", 0.0) + w.get("speaker", 0.0) + w.get("temporal", 0.0) + max(OTHER_KIND, *KIND_FACTORS.values()) * w.get("kind", 0.0)
    importance = memories.agg(F.max(F.col("importance").cast("double"))).first()[0] if "importance" in memories.columns else None
    return fixed + w.get("importance", 0.0) * max(importance or 0.0, 0.5)


def _named(found: DataFrame, queries: list, query_type: DataType) -> DataFrame:
    """Rows (q, ...) with the query's own id instead of its number."""
    spark = found.sparkSession
    names = spark.createDataFrame([(k, q.query_id) for k, q in enumerate(queries)], StructType([StructField("q", IntegerType()), StructField("query_id", query_type)]))
    return found.join(F.broadcast(names), "q").drop("q")  # the queries of one block


def reasons() -> Column:
    """Why a memory was found, by its signals."""
    given = F.array(
        F.when(F.col("cosine") > 0.3, "semantic_match").when(F.col("cosine") > 0.1, "weak_semantic_match"),
        F.when(F.col("bm25") > 0.1, "keyword_match").when(F.col("density") > 0.1, "weak_keyword_match"),
        F.when(F.col("entity") > 0.05, "entity_match"), F.when(F.col("speaker") > 0, "speaker_match"),
    )
    kept = F.filter(given, lambda r: r.isNotNull())
    return F.when(F.size(kept) == 0, F.array(F.lit("low_relevance"))).otherwise(kept)


def _digests(numbers: np.ndarray, n: int) -> np.ndarray:
    """Digests of the runs of ``n`` numbers; different runs may have equal ones."""
    out = np.zeros(max(len(numbers) - n + 1, 0), np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (numbers[j : j + len(out)] + 2).astype(np.uint64)
    return out


def contains_windows(memories: DataFrame, queries: DataFrame, window: int = 8) -> DataFrame:
    """(query_id, id) of memories with any ``window`` tokens in a row of the query, or the whole of a shorter one.

    Memories are (id, content); the windows of a block of queries go to all tasks as a set.
    """
    out = None
    for block in blocks(queries):
        bags = [(q.query_id, stemmed(q.text)) for q in block]
        vocabulary = {t: k for k, t in enumerate(sorted({t for _, b in bags for t in b}))}
        grams: dict[tuple, set] = defaultdict(set)
        for query_id, bag in bags:
            t = [vocabulary[w] for w in bag]
            n = min(window, len(t))
            for i in range(len(t) - n + 1) if n else ():
                grams[tuple(t[i : i + n])].add(query_id)
        sent = memories.sparkSession.sparkContext.broadcast((vocabulary, dict(grams)))
        query_type = queries.schema["query_id"].dataType
        schema = StructType([StructField("query_id", query_type), memories.schema["id"]])

        def found(batches: Iterator[pa.RecordBatch], sent=sent, schema=to_arrow_schema(schema)) -> Iterator[pa.RecordBatch]:
            terms, held = sent.value
            numbers = TermNumbers(terms)
            digests = {n: np.unique(_digests(np.array([g for g in held if len(g) == n]).ravel(), n)[::n]) for n in sorted({len(g) for g in held})}
            for whole in batches:
                for piece in pieces(whole):
                    ids, texts = (piece.column(c).to_pylist() for c in ("id", "content"))
                    words, of, bounds = word_numbers(texts)
                    of = known_numbers(words, of, numbers)
                    pairs = set()
                    for n, wanted in digests.items():
                        # a window has terms of the vocabulary only, and ends in its text
                        for i in np.flatnonzero(np.isin(_digests(of, n), wanted)).tolist():
                            doc = int(np.searchsorted(bounds, i, "right")) - 1
                            if i + n <= bounds[doc + 1]:
                                pairs.update((q, ids[doc]) for q in held.get(tuple(of[i : i + n].tolist()), ()))
                    q, i = list(zip(*sorted(pairs), strict=True)) or ([], [])
                    yield pa.RecordBatch.from_arrays([pa.array(q, schema.field(0).type), pa.array(i, schema.field(1).type)], names=["query_id", "id"])

        part = spread(memories.select("id", "content")).mapInArrow(found, schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def nearest(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 4, block_bytes: int = 32 << 20, rows: int = 2048) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` largest dot products of each query vector (query_id, e) with all vectors (id, e).

    Queries go to all tasks in blocks of at most ``block_bytes``, each task keeps ``k`` of each query, ties by id.  Vectors
    of another length than the queries', and nulls, are left out.
    """
    spark = vectors.sparkSession
    some = queries.filter(F.col("e").isNotNull()).agg(F.count("*").alias("n"), F.max(F.size("e")).alias("d")).first()
    n_blocks = max(1, -(-(some.n * (some.d or 0) * 8) // block_bytes))
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), vectors.schema["id"], StructField("score", DoubleType())])
    arrow, out = to_arrow_schema(schema), None
    for b in range(n_blocks):
        part = queries.filter(f"size(e) = {some.d or 0}")
        part = sorted((r.query_id, r.e) for r in (part if n_blocks == 1 else part.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)).collect())
        sent = spark.sparkContext.broadcast(([q for q, _ in part], np.array([e for _, e in part], np.float64).reshape(len(part), -1)))

        def scored(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            held, least = None, np.full(len(ids), -np.inf)
            plan = Search(limit=k, per_source=None)
            step = max(1, min(rows, CELLS // max(len(ids), 1)))
            for whole in batches:
                for a in range(0, whole.num_rows, step):
                    batch = whole.slice(a, step).to_pandas()
                    own = np.round(np.stack(batch["e"].to_numpy()).astype(np.float64) @ q.T, digits)
                    if len(own) >= k:
                        least = np.maximum(least, np.partition(own, len(own) - k, axis=0)[len(own) - k])
                    i, j = np.nonzero(own >= least[None, :])
                    new = pd.DataFrame({"q": j, "id": batch["id"].to_numpy()[i], "score": own[i, j]})
                    held = best(new if held is None else pd.concat([held, new], ignore_index=True), plan)
            if held is not None and len(held):
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"query_id": [ids[x] for x in held["q"]], "id": held["id"], "score": held["score"]}), schema=arrow, preserve_index=False)

        found = vectors.filter(f"size(e) = {some.d or 0}").select("id", "e").mapInArrow(scored, schema)
        out = found if out is None else out.unionByName(found)
    return top(out, k)
