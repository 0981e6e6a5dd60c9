"""Op 8, benchmark decontamination: truncated suffix arrays of training shards, searched with every test suffix.

A shard is a run of whole documents with a few MB of text.  Its words become ids of the benchmark's vocabulary (0:
not in it), and the suffixes that begin with two words that the benchmark has in a row (or that can meet an item of
one word) are sorted by their first ``window`` ids; all others match less than two words of any test suffix.  Every
test suffix of ``window`` words, and every shorter item, is binary-searched: the range it finds holds all its verbatim
places, and runs of places with neighbouring test suffixes give the longest match.

The benchmark is dealt once into blocks of about ``block_bytes``; a block is a broadcast of proven size, and a pass over the
documents takes ``blocks_a_pass`` of them, so no table of matches is shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, materialize, slices

#: Bytes of words stay (A-Z in lower case), all others become spaces: words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text by the contract's rule; null has none."""
    return text.encode().translate(WORD_BYTES).split() if text else []


class TestSuffixes:
    """A block of the benchmark: its vocabulary and its test suffixes, as sortable keys."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.owner: list[int] = []  # the item of each suffix
        self.item_ids = [i for i, _ in items]
        rows, lengths, self.at = [], [], []
        bigrams, single = set(), set()
        for k, (_, words) in enumerate(items):
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            bigrams.update(zip(seq, seq[1:], strict=False))
            if len(seq) == 1:
                single.add(seq[0])
            for s in range(max(1, len(seq) - window + 1) if seq else 0):
                part = seq[s : s + window]
                rows.append(part + [0] * (window - len(part)))
                lengths.append(len(part))
                self.owner.append(k)
                self.at.append(s)
        self.rows = np.array(rows, np.uint32).reshape(len(rows), window)
        self.lengths = np.array(lengths, np.int64)
        self.owner = np.array(self.owner, np.int64)
        self.at = np.array(self.at, np.int64)
        self.low = keys(self.rows)
        high = self.rows.copy()
        high[np.arange(window)[None, :] >= self.lengths[:, None]] = 0xFFFFFFFF
        self.high = keys(high)
        self.bigrams = np.array(sorted((a << 32) | b for a, b in bigrams), np.int64)
        self.single = np.array(sorted(single), np.int64)

    def search(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All verbatim places of the test suffixes in a shard: (place, suffix), and where each document starts.

        Places count words over the shard with ``window`` empty ones after each document, so none spans two.
        """
        get, pad = self.ids.get, [0] * self.window
        starts, seq = np.zeros(len(docs) + 1, np.int64), []
        for k, words in enumerate(docs):
            seq.extend([get(w, 0) for w in words])
            seq.extend(pad)
            starts[k + 1] = len(seq)
        ids = np.array(seq, np.int64)
        if not len(self.rows) or not len(ids):
            return np.empty(0, np.int64), np.empty(0, np.int64), starts
        pair = (ids[:-1] << 32) | ids[1:]
        keep = np.zeros(len(ids), bool)
        some = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        keep[some[member(self.bigrams, pair[some])]] = True
        if len(self.single):
            keep |= member(self.single, ids)
        where = np.flatnonzero(keep)
        if not len(where):
            return np.empty(0, np.int64), np.empty(0, np.int64), starts
        suffix = keys(ids.astype(np.uint32)[where[:, None] + np.arange(self.window)[None, :]])
        order = np.argsort(suffix, kind="stable")  # the suffix array
        suffix, where = suffix[order], where[order]
        lo, hi = np.searchsorted(suffix, self.low, "left"), np.searchsorted(suffix, self.high, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        place = where[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        return place, which, starts


def keys(rows: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings that sort as the rows do."""
    rows = np.ascontiguousarray(rows.astype(">u4"))
    return rows.view(f"S{4 * rows.shape[1]}").reshape(-1) if len(rows) else np.empty(0, "S4")


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def contamination(docs: list[list[bytes]], tests: TestSuffixes) -> Iterator[tuple[np.ndarray, list[str], int]]:
    """For each document: the words that are hit, the items with places in it, and the longest verbatim match."""
    place, which, starts = tests.search(docs)
    doc = np.searchsorted(starts, place, "right") - 1
    by = np.argsort(doc, kind="stable")
    place, which, doc = place[by], which[by], doc[by]
    cut = np.searchsorted(doc, np.arange(len(docs) + 1))
    for k, words in enumerate(docs):
        a, b = cut[k], cut[k + 1]
        if a == b:
            yield np.zeros(0, np.int64), [], 0
            continue
        p, w = place[a:b] - starts[k], which[a:b]
        n = tests.lengths[w]
        inside = np.cumsum(np.bincount(p, minlength=len(words) + 1) - np.bincount(p + n, minlength=len(words) + 1)[: len(words) + 1])[: len(words)] > 0
        # places of neighbouring suffixes of an item, one word on in both texts, form one longer match
        run = np.lexsort((p, p - tests.at[w], tests.owner[w]))
        q, v = p[run], w[run]
        new = np.ones(len(q), bool)
        new[1:] = (tests.owner[v][1:] != tests.owner[v][:-1]) | ((q - tests.at[v])[1:] != (q - tests.at[v])[:-1]) | (q[1:] != q[:-1] + 1)
        first = np.flatnonzero(new)
        longest = int((np.diff([*first, len(q)]) - 1 + tests.lengths[v][first]).max())
        yield np.flatnonzero(inside), sorted({i for k in np.unique(tests.owner[w]).tolist() if (i := tests.item_ids[k]) is not None}), longest


def blocks(benchmark: DataFrame, block_bytes: int, item_col: str, text_col: str) -> Iterator[list]:
    """The benchmark's items in blocks of about ``block_bytes`` each; the driver holds one block at a time, and each is read alone."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    if n > 1:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        items = materialize(dealt, "benchmark-blocks", "block")
    for k in range(n):
        part = items if n == 1 else items.filter(F.col("block") == k)
        yield [(r.item_id, words_of(r.text)) for r in part.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = 4 << 20, blocks_a_pass: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Adds ``n_words``, ``hit_words`` (places), ``hit_items`` (ids as strings, sorted) and ``longest_match`` to every document.

    Words, windows and hits as in the module text; an item without words matches nothing, a null or empty document has
    no words.  Items of one id are one item each row but listed once; the windows of an item without an id hit words, but
    there is no id to list.  Repeated documents are judged each; all columns of ``docs`` stay (its own columns of these four
    names are replaced).
    """
    spark = docs.sparkSession
    out = docs.drop("n_words", "hit_words", "hit_items", "longest_match").withColumns({"n_words": F.lit(0).cast("long"), "hit_words": F.array().cast("array<long>"), "hit_items": F.array().cast("array<string>"), "longest_match": F.lit(0).cast("long")})
    schema = out.schema
    dealt = blocks(benchmark, block_bytes, item_col, item_text_col)
    while some := [spark.sparkContext.broadcast(b) for b in itertools.islice(dealt, blocks_a_pass)]:

        def scan(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            every = [TestSuffixes(b.value, window) for b in some]
            for whole in batches:
                for batch in slices(whole, text_col):
                    texts = [words_of(t) for t in batch.column(text_col).to_pylist()]
                    hits, seen, most = batch.column("hit_words").to_pylist(), batch.column("hit_items").to_pylist(), batch.column("longest_match").to_pylist()
                    for tests in every:
                        for k, (places, found, longest) in enumerate(contamination(texts, tests)):
                            if longest:
                                hits[k] = np.union1d(np.array(hits[k], np.int64), places).tolist()
                                seen[k] = sorted({*seen[k], *found})
                                most[k] = max(most[k], longest)
                    new = {"n_words": pa.array([len(t) for t in texts], pa.int64()), "hit_words": pa.array(hits, pa.list_(pa.int64())), "hit_items": pa.array(seen, pa.list_(pa.string())), "longest_match": pa.array(most, pa.int64())}
                    yield pa.RecordBatch.from_arrays([new.get(c, batch.column(j)) for j, c in enumerate(batch.schema.names)], names=batch.schema.names)

        out = out.mapInArrow(scan, schema)
    return out


#: A document counts as contaminated when a word is hit and 20 times the words hit are at least its words.
CONTAMINATED = "size(hit_words) > 0 and 20L * size(hit_words) >= n_words"


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns of ``docs``.

    Null and empty texts, and all documents of an empty benchmark, stay; repeated rows are judged each.
    """
    return find_contamination(docs, benchmark, **options).filter(~F.expr(CONTAMINATED)).select(*docs.columns)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the whole benchmark is in every document; edge cases as in ``find_contamination``."""
    found = find_contamination(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.selectExpr(
        "doc_id", "n_words", "cast(size(hit_words) as long) n_hit", "cast(size(hit_items) as long) n_items",
        "sha2(array_join(array_sort(hit_items), ','), 256) items_sha256",
        f"{CONTAMINATED} contaminated", "longest_match",
    )


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT *, CAST(least(len(w), 13) AS BIGINT) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM k)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hit GROUP BY doc_id),
run AS (SELECT doc_id, max(e) AS longest_match FROM (SELECT doc_id, count(*) + max(n) - 1 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, spot - i ORDER BY i) AS grp, spot - i AS diag FROM (
  SELECT doc_id, item_id, h.n, h.i, spot FROM hit h JOIN (SELECT item_id, n, i AS spot, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM k)) p USING (item_id, n) JOIN dw USING (doc_id, n, i) WHERE dw.g = p.g)) GROUP BY doc_id, item_id, diag, grp) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated, coalesce(longest_match, 0) AS longest_match
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN run USING (doc_id)
"""
