"""Op 3, substring dedup: matching statistics against suffix automata of reference shards.

Two documents that share a window of ``window`` words share the window's anchor, the smallest digest of its grams of
``GRAM`` words.  Each document gives, for each run of windows of one anchor, a passage: (anchor, digest of the
passage's words).  Distinct passages of one anchor, with the smallest and the largest document of each, form a
reference shard: in the order of their first documents they are streamed against a suffix automaton of those before,
whose matching statistics of ``window`` words or more are the windows that the first document has to give up; then they
are added to it, and the statistics of what was added are the windows that all later documents have to give up.
A passage that very many documents quote makes shards of very many passages, which differ in what each document has
around the quote.  In shards of more than ``SHARD`` passages every passage is first cut to what it shares with any other
one: passages of an anchor are aligned at its gram, so their words before it and after it are each sorted, and neighbours
in that order share most.  The cut passages are few again, and are streamed as above.  Only where more than ``SHARD`` are
left are the windows of these compared by 128-bit digests in an aggregation, so that no automaton grows with the corpus.

Automata are not broadcast: passages are sent to their shard.  Texts are shuffled only where they may hold a passage of
a shard, or may lose words; a bitmap of bounded size tells that at the scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, documents, gram_hashes, materialize, mix, sequence_hash, sieve, sifted, slices, word_hashes

WINDOW, GRAM, SHARD = 50, 10, 256
_B = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def anchors(h: np.ndarray, window: int) -> np.ndarray:
    """For every window of words (given by their digests) the place of its anchor; the leftmost of equal ones."""
    g = gram_hashes(h, GRAM)
    out = []
    span, step = window - GRAM + 1, 1 << 19
    for a in range(0, len(h) - window + 1, step):
        part = g[a : a + step + span - 1]
        key = (part & ~np.uint64((1 << 20) - 1)) | np.arange(len(part), dtype=np.uint64)
        done = 1
        while 2 * done <= span:
            key = np.minimum(key[: len(key) - done], key[done:])
            done *= 2
        if done < span:
            key = np.minimum(key[: len(key) - (span - done)], key[span - done :])
        out.append((key & np.uint64((1 << 20) - 1)).astype(np.int64) + a)
    return np.concatenate(out)


def passages(words: list[bytes], window: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """(anchor digest, passage digest, number of windows, starts) of a document's distinct passages."""
    if len(words) < window:
        return
    h = word_hashes(words)
    at = anchors(h, window)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, len(at)])
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(h), _B, np.uint64)], dtype=np.uint64)
        sums = np.r_[np.uint64(0), np.cumsum(mix(h) * power[:-1], dtype=np.uint64)]
        # divided by the power at its start, so equal passages have equal sums wherever they stand
        scale = power[len(h) - first] * np.uint64(pow(int(_B), -len(h), 1 << 64))
        whole = mix((sums[first + count + window - 1] - sums[first]) * scale + count.astype(np.uint64))
    tops = gram_hashes(h, GRAM)[at[first]].view(np.int64).tolist()
    found: dict[tuple[int, int, int], list[int]] = {}
    for f, p, n, s in zip(tops, whole.view(np.int64).tolist(), count.tolist(), first.tolist(), strict=True):
        found.setdefault((f, p, n), []).append(s)
    for (f, p, n), starts in found.items():
        yield f, p, n, starts


class SuffixAutomaton:
    """A suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _new(self, length: int, link: int, to: dict[bytes, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:
                if self.length[q] == self.length[last] + 1:
                    last = q
                else:
                    last = self._split(last, w, q)
                continue
            cur, p = self._new(self.length[last] + 1, 0, {}), last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            last = cur

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def statistics(self, words: list[bytes]) -> Iterator[int]:
        """The length of the longest match that ends at each word."""
        state = n = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                n = 0
            yield n


def runs(windows: list[int], window: int) -> list[dict[str, int]]:
    """Word intervals of sorted windows, neighbouring ones joined."""
    out: list[dict[str, int]] = []
    for w in windows:
        if out and w <= out[-1]["e"] - window + 1:
            out[-1]["e"] = w + window
        else:
            out.append({"s": w, "e": w + window})
    return out


def shard_windows(group: list[tuple[int, int, int, bytes]], window: int) -> Iterator[tuple[int, list, list]]:
    """For one anchor's passages (first document, last document, passage digest, words), in the order of their first
    documents: (passage digest, spans that its first document gives up, spans that later documents give up)."""

    def matched(words: list[bytes]) -> list[int]:
        return [e - window + 1 for e, n in enumerate(automaton.statistics(words)) if n >= window]

    automaton, waiting, doc = SuffixAutomaton(), [], None

    def add() -> Iterator[tuple[int, list, list]]:
        for p, words, hit, again in waiting:
            if len(hit) < len(words) - window + 1:
                automaton.add(words)
        for p, words, hit, again in waiting:
            if hit or again:
                yield p, runs(hit, window), runs(matched(words), window) if again else []
        waiting.clear()

    for first, last, p, text in group:
        if first != doc:
            yield from add()
            doc = first
        words = text.split()
        waiting.append((p, words, matched(words), last > first))
    yield from add()


def batch_of(out: list[tuple], names: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, names.values(), strict=True)], names=list(names))


SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_SPANS = "array<struct<s:int,e:int>>"


def decided(texts: DataFrame, window: int) -> DataFrame:
    """(f, p, own, later) of passages (f, p, first, last, words): what the first document gives up, and what later ones do."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards as runs of sorted rows; one shard is held at a time."""
        names = {"f": pa.int64(), "p": pa.int64(), "own": SPANS, "later": SPANS}
        held: list[tuple[int, int, int, bytes]] = []
        anchor, out = None, []
        for batch in batches:
            for f, p, first, last, words in zip(*(batch.column(c).to_pylist() for c in ("f", "p", "first", "last", "words")), strict=True):
                if f != anchor:
                    out += [(anchor, *x) for x in shard_windows(held, window)]
                    held.clear()
                    anchor = f
                held.append((first, last, p, words))
            yield batch_of(out, names)
            out.clear()
        yield batch_of([(anchor, *x) for x in shard_windows(held, window)], names)

    shard = texts.select("f", "p", "first", "last", "words").repartition("f").sortWithinPartitions("f", "first", "p")
    return shard.mapInArrow(streamed, f"f long, p long, own {_SPANS}, later {_SPANS}")


def decided_by_digest(texts: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """As ``decided``, by an aggregation of the digests of all windows."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {"f": pa.int64(), "p": pa.int64(), "first": pa.int64(), "i": pa.int32(), "digest": pa.binary()}
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                out = []
                for f, p, d, t in zip(*(batch.slice(a, 512).column(c).to_pylist() for c in ("f", "p", "first", "words")), strict=True):
                    words = t.split()
                    out += [(f, p, d, i, hashlib.md5(b" ".join(words[i : i + window])).digest()) for i in range(len(words) - window + 1)]
                yield batch_of(out, names)

    each = scratch.table(texts.select("f", "p", "first", "words").mapInArrow(digests, "f long, p long, first long, i int, digest binary"), "windows")
    least = each.groupBy("digest").agg(F.min("first").alias("least"), F.max("first").alias("most")).filter("most > least").select("digest", "least")
    hit = each.join(least, "digest").filter("first > least").groupBy("f", "p").agg(F.array_sort(F.collect_set("i")).alias("h"))
    # a run begins where the window before is not there, and ends where the one after is not
    own = f"transform(arrays_zip(filter(h, (x, k) -> k = 0 or h[greatest(k - 1, 0)] <> x - 1), filter(h, (x, k) -> k = size(h) - 1 or h[least(k + 1, size(h) - 1)] <> x + 1)), z -> named_struct('s', z['0'], 'e', z['1'] + {window}))"
    out = texts.select("f", "p", "first", "last", "n").distinct().join(hit, ["f", "p"], "left").filter("h is not null or last > first")
    return out.selectExpr("f", "p", f"coalesce({own}, array()) own", f"if(last > first, array(named_struct('s', 0, 'e', n + {window - 1})), array()) later")


#: Bytes under the separator, a tab, become ones that UTF-8 does not use, so that keys sort word by word.
_ABOVE = bytes(b + 0xF5 if b < 9 else b for b in range(256))


def sort_key(words: list[bytes]) -> bytes:
    return b"\t".join(w.translate(_ABOVE) for w in words)


def cut_passages(texts: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(f, p, first, last, n, q, at, words): passages cut to what they share with another one of their anchor.

    ``q`` is the digest of the words that are left, ``at`` their place in the passage; passages that share no window go.
    """

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words before the gram, nearest first, and after it, as sortable keys."""
        names = {"f": pa.int64(), "p": pa.int64(), "side": pa.int32(), "key": pa.binary()}
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                out = []
                for f, p, t in zip(*(batch.slice(a, 1024).column(c).to_pylist() for c in ("f", "p", "words")), strict=True):
                    words = t.split()
                    gram = int(anchors(word_hashes(words), window)[0])
                    out += [(f, p, 0, sort_key(words[:gram][::-1])), (f, p, 1, sort_key(words[gram + GRAM :]))]
                yield batch_of(out, names)

    each = scratch.table(texts.select("f", "p", "words").mapInArrow(sides, "f long, p long, side int, key binary"), "sides")
    keys = each.groupBy("f", "side", "key").agg(F.count_distinct("p").alias("n"))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted keys, how many words each shares with any other; all at the ends of a partition, where a neighbour is not seen."""
        names = {"f": pa.int64(), "side": pa.int32(), "key": pa.binary(), "most": pa.int32()}

        def common(a: list[bytes], b: list[bytes]) -> int:
            return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

        before = None  # (f, side, key, words, most so far)
        for batch in batches:
            out = []
            for f, side, key, n in zip(*(batch.column(c).to_pylist() for c in ("f", "side", "key", "n")), strict=True):
                words = key.split(b"\t") if key else []
                most = len(words) if n > 1 or before is None else 0
                if before is not None:
                    if before[:2] == (f, side):
                        both = common(before[3], words)
                        most, last = max(most, both), max(before[4], both)
                    else:
                        last = before[4]
                    out.append((*before[:3], last))
                before = (f, side, key, words, most)
            yield batch_of(out, names)
        if before is not None:
            yield batch_of([(*before[:3], len(before[3]))], names)

    ordered = keys.repartitionByRange("f", "side", "key").sortWithinPartitions("f", "side", "key")
    most = ordered.mapInArrow(shared, "f long, side int, key binary, most int")
    per = each.join(most, ["f", "side", "key"]).groupBy("f", "p").agg(F.max(F.when(F.col("side") == 0, F.col("most"))).alias("before"), F.max(F.when(F.col("side") == 1, F.col("most"))).alias("after"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {"f": pa.int64(), "p": pa.int64(), "first": pa.int64(), "last": pa.int64(), "n": pa.int32(), "q": pa.int64(), "at": pa.int32(), "words": pa.binary()}
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                out = []
                for f, p, first, last, n, t, left, right in zip(*(batch.slice(a, 1024).column(c).to_pylist() for c in ("f", "p", "first", "last", "n", "words", "before", "after")), strict=True):
                    words = t.split()
                    h = word_hashes(words)
                    gram = int(anchors(h, window)[0])
                    lo, hi = gram - left, gram + GRAM + right
                    if hi - lo >= window:
                        out.append((f, p, first, last, n, sequence_hash(h[lo:hi]), lo, b" ".join(words[lo:hi])))
                yield batch_of(out, names)

    rows = texts.join(per, ["f", "p"]).select("f", "p", "first", "last", "n", "words", "before", "after")
    return rows.mapInArrow(cut, "f long, p long, first long, last long, n int, q long, at int, words binary")


def decided_crowded(texts: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """As ``decided``, for shards of very many passages: what they share with others is decided, once for equal parts."""
    cut = scratch.table(cut_passages(texts, window, scratch), "cut")
    parts = cut.groupBy("f", "q").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("words").alias("words"))
    sizes = parts.groupBy("f").agg(F.count("*").alias("size"))
    parts = scratch.table(parts.join(sizes, "f").withColumnRenamed("q", "p").withColumn("n", F.expr(f"size(split(cast(words as string), ' ')) - {window - 1}")), "parts")
    many = parts.filter(f"size > {SHARD}")
    found = decided(parts.filter(f"size <= {SHARD}"), window)
    if not many.isEmpty():
        found = found.unionByName(decided_by_digest(many, window, scratch))
    found = found.join(parts.selectExpr("f", "p", "first part_first"), ["f", "p"]).withColumnRenamed("p", "q")
    # the first document of a passage is the part's first one, or a later one; later documents of it give up all
    rows = texts.select("f", "p", "first", "last", "n").join(cut.select("f", "p", "q", "at"), ["f", "p"], "left").join(found, ["f", "q"], "left")
    moved = "transform(if(first = part_first, own, later), r -> named_struct('s', r.s + at, 'e', r.e + at))"
    out = rows.selectExpr("f", "p", f"coalesce({moved}, array()) own", f"if(last > first, array(named_struct('s', 0, 'e', n + {window - 1})), array()) later")
    return out.filter("size(own) > 0 or size(later) > 0").distinct()


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, spans): for texts (their digest is t) with words to remove, intervals of words (they may overlap)."""
    rows, scratch = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"xxhash64(`{text_col}`) t", f"`{text_col}` text").filter("doc_id is not null"), Scratch(docs.sparkSession, "sub")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {"doc_id": pa.int64(), "t": pa.int64(), "f": pa.int64(), "p": pa.int64(), "n": pa.int32(), "starts": pa.list_(pa.int32())}
        for whole in batches:
            for batch in slices(whole, "text"):
                columns = (batch.column(c).to_pylist() for c in ("doc_id", "t", "text"))
                yield batch_of([(d, t, *p) for d, t, text in zip(*columns, strict=True) for p in passages(words_of(text), window)], names)

    found = scratch.table(rows.mapInArrow(cut, "doc_id long, t long, f long, p long, n int, starts array<int>"), "passages").withColumn("fp", F.xxhash64("f", "p"))
    distinct = scratch.table(found.groupBy("f", "p").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "distinct")
    shards = distinct.groupBy("f").agg(F.count("*").alias("size"), F.min("first").alias("a"), F.max("last").alias("b")).filter("b > a").select("f", "size")
    wanted = scratch.table(distinct.join(shards, "f").withColumn("fp", F.xxhash64("f", "p")), "wanted")
    held = sieve(found, wanted.select("fp"), "fp").drop("fp")
    chosen = held.join(wanted.drop("fp"), ["f", "p"]).filter("doc_id = first")
    asked = scratch.table(chosen.groupBy("doc_id", "t").agg(F.collect_list(F.struct("f", "p", "n", F.expr("starts[0] s"), "size", "last")).alias("asked")), "asked")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {"f": pa.int64(), "p": pa.int64(), "first": pa.int64(), "last": pa.int64(), "size": pa.int64(), "n": pa.int32(), "words": pa.binary()}
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                out = []
                for d, text, ask in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "asked")), strict=True):
                    words = words_of(text)
                    out += [(a["f"], a["p"], d, a["last"], a["size"], a["n"], b" ".join(words[a["s"] : a["s"] + a["n"] + window - 1])) for a in ask]
                yield batch_of(out, names)

    texts = sieve(rows, asked.select("doc_id"), "doc_id").join(asked, ["doc_id", "t"]).select("doc_id", "text", "asked")
    texts = scratch.table(texts.mapInArrow(fetch, "f long, p long, first long, last long, size long, n int, words binary"), "texts")
    small = decided(texts.filter(f"size <= {SHARD}"), window)
    crowded = texts.filter(f"size > {SHARD}")
    hits = small.unionByName(decided_crowded(crowded, window, scratch)) if not crowded.isEmpty() else small
    hits = scratch.table(hits.join(wanted.select("f", "p", "first", "fp"), ["f", "p"]), "hits")
    lost = sieve(found, hits.select("fp"), "fp").drop("fp").join(hits.drop("fp"), ["f", "p"]).withColumn("lost", F.expr("if(doc_id = first, own, later)"))
    spans = lost.select("doc_id", "t", F.expr("flatten(transform(starts, s -> transform(lost, r -> named_struct('s', s + r.s, 'e', s + r.e))))").alias("spans")).filter("size(spans) > 0")
    spans = materialize(spans.groupBy("doc_id", "t").agg(F.flatten(F.collect_list("spans")).alias("spans")), "sub-spans")
    scratch.drop()
    return spans


def kept_words(words: list[bytes], spans: list[dict[str, int]] | None) -> list[bytes]:
    if not spans:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, [s["s"] for s in spans], 1)
    np.add.at(gone, [min(s["e"], len(words)) for s in spans], -1)
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of ``docs``; ``kept`` holds the words left, joined by one space.

    Words are split at ASCII white space.  A word goes if it is in a window of ``window`` words whose word sequence is
    also in a document with a smaller id.  Null and empty texts have no words; rows with a null id keep all their words
    and are no reference; repeated rows of an id are returned each, whether their texts are equal or not, and none is a
    reference for another.  Other columns are not read.
    """
    spans = repeated_spans(docs, window, id_col, text_col)
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"xxhash64(`{text_col}`) t", f"`{text_col}` text")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = [words_of(t) for t in batch.column("text").to_pylist()]
                kept = [kept_words(w, s) for w, s in zip(words, batch.column("spans").to_pylist(), strict=True)]
                n = [len(w) for w in words]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([a - len(k) for a, k in zip(n, kept, strict=True)], pa.int64()), pa.array([b" ".join(k).decode() for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    # texts that surely keep all their words go by the join
    marked = sifted(rows, spans.select("doc_id"), "doc_id", "m_in")
    through = marked.filter("m_in").join(spans, ["doc_id", "t"], "left").select("doc_id", "text", "spans")
    whole = marked.filter("not m_in").select("doc_id", "text", F.lit(None).cast(_SPANS).alias("spans"))
    return whole.unionByName(through).mapInArrow(cleaned, "doc_id long, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what ``remove_repeats`` keeps of all documents; nulls, empty texts and repeated rows as there."""
    cleaned = remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
gone AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM gone),
ws AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT ws.doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY ws.i) AS t FROM ws ANTI JOIN cov ON ws.doc_id = cov.doc_id AND ws.i = cov.i GROUP BY ws.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
