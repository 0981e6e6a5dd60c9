"""Op 13, phrase collocation mining: suffix automata of shards to a bounded depth, counts reduced over the corpus.

A shard is some 16 MB of texts of one language as word numbers.  Its generalised suffix automaton is built to the depth
that phrases need, as the tree of its suffix links: that tree is the trie of all contexts read backwards, so sorting
(word, word before it, ...) gives its nodes level by level, with the sizes of their sets of end positions as runs.  The
node of a phrase is linked to that of the phrase without its first word.

Counts are reduced in rounds, so that the many phrases that are rare everywhere stay in their shards.  First each shard
gives digests of its words and pairs of words with their counts, packed by ranges of digests; for each it gets back one
bit, whether the sum over all shards is frequent (equal digests of two phrases can only let more through).  The second
round does the same for triples whose link and whose first two words are frequent.  Then a shard enumerates what is left,
with exact counts, packed by the same ranges, and a range sums them by phrase: a frequent phrase becomes a row once, and
not once for each shard that it is in.
A phrase is subsumed through the links of the longer ones: to what they are without their first, or their last, word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, documents, mix, slices, word_hashes
from .alignment import packed, unpacked

LEAST, TOP, PERCENT = 10, 2000, 50
SHARD_BYTES = 16 << 20
#: Bits of a digest.
BITS = 40
#: Bytes in ASCII lower case; of words (0), between words (1) and between pieces (2).
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_KIND = np.array([2 if b in b".,;:!?\n\x0b\x0c\r" else 1 if b in b" \t" else 0 for b in range(256)], np.uint8)


def numbered(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of texts, and the texts as their numbers from 1 on; 0 stands between pieces and texts."""
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    kind = _KIND[data]
    word = kind == 0
    starts = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    if not len(starts):
        return [], np.empty(0, np.int64)
    ends = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    offsets = np.r_[0, np.cumsum(ends - starts)]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[word]])]).dictionary_encode()
    piece = np.cumsum(kind == 2)[starts]
    cut = np.cumsum(np.r_[0, piece[1:] != piece[:-1]])
    out = np.zeros(len(starts) + int(cut[-1]), np.int64)
    out[np.arange(len(starts)) + cut] = words.indices.to_numpy().astype(np.int64) + 1
    return words.dictionary.to_pylist(), out


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


class BoundedAutomaton:
    """The suffix automaton of a shard's pieces to depth three, as its tree of suffix links.

    A node of depth one is a word, of depth two a word and the one before it (its link is the word), and so on; ``n`` is
    the size of its set of end positions.
    """

    def __init__(self, lang: str, words: list[bytes], ids: np.ndarray):
        self.words, self.ids = words, ids
        self.n1 = np.bincount(ids, minlength=len(words) + 1)[1:]
        self.pair_at = np.flatnonzero((ids[1:] > 0) & (ids[:-1] > 0)) + 1  # where a pair ends
        self.pair = ids[self.pair_at] << 32 | ids[self.pair_at - 1]
        self.nodes2, self.n2 = runs(self.pair)
        with np.errstate(over="ignore"):
            self.h1 = mix(word_hashes(words) ^ word_hashes([lang.encode()])[0]) if words else np.empty(0, np.uint64)
            self.h2 = self._joined(self.h1[(self.nodes2 >> 32) - 1], self.h1[(self.nodes2 & 0xFFFFFFFF) - 1])

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)

    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """(digests, counts) of all words, then of all pairs."""
        return np.concatenate([self.h1, self.h2]) >> np.uint64(64 - BITS), np.concatenate([self.n1, self.n2])

    def keep(self, frequent: np.ndarray) -> None:
        """Leaves the words and pairs that are ``frequent``, in the order of ``short``, and triples whose link and first two words are."""
        self.one, two = np.flatnonzero(frequent[: len(self.n1)]), frequent[len(self.n1) :]
        self.two, self.two_n, self.h2_left = self.nodes2[two], self.n2[two], self.h2[two]
        self.three = self.three_n = np.empty(0, np.int64)
        self.h3 = np.empty(0, np.uint64)
        if len(self.two):
            at = np.minimum(np.searchsorted(self.two, self.pair), len(self.two) - 1)
            held = self.two[at] == self.pair
            # a triple ends where a pair does, and the word before that pair ends one, too
            here = np.flatnonzero(held[1:] & held[:-1] & (self.pair_at[1:] == self.pair_at[:-1] + 1)) + 1
            self.three, self.three_n = runs(at[here] << 32 | self.ids[self.pair_at[here] - 2])
            self.h3 = self._joined(self.h2_left[self.three >> 32], self.h1[(self.three & 0xFFFFFFFF) - 1])

    def long(self) -> tuple[np.ndarray, np.ndarray]:
        """(digests, counts) of the triples that ``keep`` has left."""
        return self.h3 >> np.uint64(64 - BITS), self.three_n

    def enumerated(self, frequent: np.ndarray) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """(depth, numbers of the phrase's words from 0, counts) of what ``keep`` has left, of triples the ``frequent`` ones."""
        yield 1, [self.one], self.n1[self.one]
        yield 2, [(self.two & 0xFFFFFFFF) - 1, (self.two >> 32) - 1], self.two_n
        three = self.three[frequent]
        link = self.two[three >> 32]
        yield 3, [(three & 0xFFFFFFFF) - 1, (link & 0xFFFFFFFF) - 1, (link >> 32) - 1], self.three_n[frequent]

    def phrases(self, frequent: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """What is ``enumerated``: (phrases, their digests, counts)."""
        words, texts, counts = pa.array(self.words, pa.binary()).cast(pa.string()), [], []
        for k, of, n in self.enumerated(frequent):
            held = [words.take(pa.array(x)) for x in of]
            texts.append(pa.compute.binary_join_element_wise(*held, " ") if k > 1 else held[0])
            counts.append(n)
        digests = np.concatenate([self.h1[self.one], self.h2_left, self.h3[frequent]]) >> np.uint64(64 - BITS)
        return pa.concat_arrays(texts), digests, np.concatenate(counts)


def shards(docs: DataFrame) -> DataFrame:
    """(shard, lang, n_words, words, ids) of docs (lang, text); one row a language and shard."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                words, ids = numbered(texts)
                out = [[uuid.uuid4().int >> 65], [lang], [int((ids > 0).sum())], [pa.compress(b"\n".join(words), codec="zstd", asbytes=True)], [len(b"\n".join(words))], [packed(ids)]]
                types = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["shard", "lang", "n_words", "words", "size", "ids"])
            held.clear()

        for whole in batches:
            for batch in slices(whole, "text"):
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if text:
                        held.setdefault(lang, []).append(text)
                        size += len(text)
                if size >= SHARD_BYTES:
                    yield from rows()
                    size = 0
        yield from rows()

    return docs.mapInArrow(made, "shard long, lang string, n_words long, words binary, size long, ids binary")


def opened(row: dict) -> BoundedAutomaton:
    words = pa.decompress(row["words"], row["size"], codec="zstd", asbytes=True).split(b"\n") if row["size"] else []
    return BoundedAutomaton(row["lang"], words, unpacked(row["ids"]))


def chunks(shard: int, digests: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows (part, shard, digests, counts): sorted digests by their ranges, packed."""
    order = np.argsort(digests, kind="stable")
    digests, counts = digests[order].astype(np.int64), counts[order]
    of = digests >> (BITS - parts.bit_length() + 1)
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
    ends = np.r_[cuts[1:], len(of)]
    held = [[packed(np.diff(digests[a:b], prepend=0)) for a, b in zip(cuts, ends, strict=False)], [packed(counts[a:b]) for a, b in zip(cuts, ends, strict=False)]]
    return pa.RecordBatch.from_arrays([pa.array(of[cuts]), pa.array(np.full(len(cuts), shard)), *(pa.array(h, pa.binary()) for h in held)], names=["part", "shard", "digests", "counts"])


def marked(rows: DataFrame, least: int, name: str) -> DataFrame:
    """(shard, name): for each digest of ``chunks``, in their order, a bit: whether its counts add up to ``least`` over all shards.

    A range is held whole; their number follows the corpus, so one is of some two million entries.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def done() -> pa.RecordBatch:
            every = np.concatenate([d for _, d, _ in held])
            order = np.argsort(every, kind="stable")
            in_order = every[order]
            first = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]])
            total = np.add.reduceat(np.concatenate([n for _, _, n in held])[order], first)
            frequent = np.empty(len(every), bool)
            frequent[order] = np.repeat(total >= least, np.diff(np.r_[first, len(every)]))
            ends = np.cumsum([len(d) for _, d, _ in held])
            bits = [np.packbits(frequent[e - len(d) : e]).tobytes() for e, (_, d, _) in zip(ends, held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in held]), pa.array([part] * len(held)), pa.array([len(d) for _, d, _ in held], pa.int32()), pa.array(bits, pa.binary())], names=["shard", "part", "n", "bits"])

        for batch in batches:
            for p, shard, digests, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "digests", "counts")), strict=True):
                if p != part:
                    if held:
                        yield done()
                    part, held = p, []
                held.append((shard, np.cumsum(unpacked(digests)), unpacked(counts)))
        if held:
            yield done()

    bits = rows.repartition("part").sortWithinPartitions("part").mapInArrow(stream, "shard long, part long, n int, bits binary")
    return bits.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("part", "n", "bits"))).alias(name))


def flags(marks: list[dict] | None, digests: np.ndarray) -> np.ndarray:
    """The bits of ``marked`` in the order of the digests as they were given to ``chunks``."""
    out = np.zeros(len(digests), bool)
    held = [np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=m["n"]).astype(bool) for m in marks or ()]
    if held:
        out[np.argsort(digests, kind="stable")] = np.concatenate(held)
    return out


def phrase_chunks(lang: str, phrases: pa.Array, digests: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows (part, lang, phrases, size, counts): phrases by the ranges of their digests, packed; no word has a line end."""
    of = digests.astype(np.int64) >> (BITS - parts.bit_length() + 1)
    order = np.argsort(of, kind="stable")  # neighbours share words
    of, counts = of[order], counts[order]
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
    ends = np.r_[cuts, len(of)]
    joined = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), phrases.take(pa.array(order))), "\n").cast(pa.binary()).to_pylist() if len(of) else []
    held = [[pa.compress(x, codec="zstd", asbytes=True) for x in joined], [len(x) for x in joined], [packed(counts[a:b]) for a, b in zip(cuts, ends[1:], strict=True)]]
    types = (pa.binary(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(of[cuts]), pa.array([lang] * len(cuts), pa.string()), *(pa.array(h, t) for h, t in zip(held, types, strict=True))], names=["part", "lang", "phrases", "size", "counts"])


#: Phrases of a range that are held before they are summed, besides those that are different.
UNSUMMED = 1 << 20


def summed(rows: DataFrame, least: int) -> DataFrame:
    """(lang, k, phrase, n) of the phrases of ``phrase_chunks`` whose counts add up to ``least``, exactly; a range's are summed as they come."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, held, waiting = None, None, [], 0

        def added() -> pa.Table:
            table = pa.concat_tables(held if total is None else [total, *held])
            return table.group_by("phrase", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})

        def done() -> Iterator[pa.RecordBatch]:
            whole = added() if held else total
            whole = whole.filter(pa.compute.greater_equal(whole.column("n"), least))
            k = pa.compute.add(pa.compute.count_substring(whole.column("phrase"), " "), 1).cast(pa.int32())
            lang = pa.array([key[1]] * whole.num_rows, pa.string())
            yield from pa.table({"lang": lang, "k": k, "phrase": whole.column("phrase"), "n": whole.column("n")}).to_batches()

        for batch in batches:
            for part, lang, phrases, size, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "phrases", "size", "counts")), strict=True):
                if (part, lang) != key:
                    if key is not None:
                        yield from done()
                    key, total, held, waiting = (part, lang), None, [], 0
                text = pa.decompress(phrases, size, codec="zstd", asbytes=True)
                held.append(pa.table({"phrase": pa.compute.split_pattern(pa.array([text], pa.binary()).cast(pa.string()), "\n").flatten(), "n": unpacked(counts)}))
                waiting += held[-1].num_rows
                if waiting >= UNSUMMED:
                    total, held, waiting = added(), [], 0
        if key is not None:
            yield from done()

    return rows.repartition("part").sortWithinPartitions("part", "lang").mapInArrow(stream, "lang string, k int, phrase string, n long")


def phrase_counts(made: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(lang, k, phrase, n) of all phrases of ``k`` = 1 to 3 words that are in the shards ``least`` times or more."""
    total = made.agg(F.sum("n_words")).first()[0] or 0
    parts = 1 << min(BITS, max(0, (int(total) >> 20).bit_length()))
    schema = "part long, shard long, digests binary, counts binary"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield chunks(row["shard"], *opened(row).short(), parts)

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                automaton = opened(row)
                automaton.keep(flags(row["short"], automaton.short()[0]))
                yield chunks(row["shard"], *automaton.long(), parts)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                automaton = opened(row)
                automaton.keep(flags(row["short"], automaton.short()[0]))
                yield phrase_chunks(row["lang"], *automaton.phrases(flags(row["long"], automaton.long()[0])), parts)

    first = scratch.table(marked(made.mapInArrow(short, schema), least, "short"), "short")
    both = made.join(first, "shard")
    second = scratch.table(marked(both.mapInArrow(long, schema), least, "long"), "long")
    return summed(both.join(second, "shard", "left").mapInArrow(phrases, "part long, lang string, phrases binary, size long, counts binary"), least)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = PERCENT, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language, by score, count and phrase.

    Texts in ASCII lower case are cut into pieces at ``[.,;:!?]`` and ASCII line ends, and those into words at spaces and
    tabs.  ``n`` counts a language's words, ``a`` a phrase's occurrences within pieces; phrases have two or three words
    and occur ``least`` times or more.  ``l`` and ``r`` count the two parts of the cut with the lowest
    floor(1000000 a a / (l r)), the score; of equal ones the first.  A phrase goes if a longer one around it has
    ``percent`` % of its occurrences.  A null language is ``und``; null, empty and blank texts have no words; repeated rows
    count each.  Languages without such phrases have no rows.  Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    made = scratch.table(shards(docs.selectExpr(f"coalesce(`{lang_col}`, 'und') lang", f"`{text_col}` text")), "shards")
    grams = scratch.table(phrase_counts(made, least, scratch), "grams")
    first, rest = F.substring_index("phrase", " ", 1), F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    start, last = F.expr("substring(phrase, 1, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1)"), F.substring_index("phrase", " ", -1)
    cuts = F.when(F.col("k") == 2, F.array(F.struct(F.lit(1).alias("cut"), first.alias("first"), rest.alias("rest"))))
    cuts = cuts.otherwise(F.array(F.struct(F.lit(1).alias("cut"), first.alias("first"), rest.alias("rest")), F.struct(F.lit(2).alias("cut"), start.alias("first"), last.alias("rest"))))
    several = grams.filter("k > 1").withColumnRenamed("n", "a")
    cut = several.select("lang", "phrase", "k", "a", F.inline(cuts))
    for side, count in (("first", "l"), ("rest", "r")):
        cut = cut.join(grams.select("lang", F.col("phrase").alias(side), F.col("n").alias(count)), ["lang", side])
    exact = F.expr("cast((1000000 * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)")
    least_cut = cut.withColumn("score", exact).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    scored = least_cut.select("lang", "phrase", "k", "a", "m.l", "m.r", "m.score")
    # the suffix link of a longer phrase, and the node that it was reached from
    longer = several.filter("k = 3").select("lang", F.explode(F.array_distinct(F.array(start, rest))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {percent} * a").drop("longer", "k")
    kept = scratch.table(kept, "kept")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's phrases are first ranked in parts
    parts = kept.count() // 20_000 + 1
    deal = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    some = kept.withColumn("part", deal).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    sizes = made.groupBy("lang").agg(F.sum("n_words").alias("n"))
    out = scratch.lasting(ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "out")
    scratch.drop()
    return out


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of all documents; null, empty and very long texts, and repeated rows, as in ``collocations``."""
    return collocations(documents(spark, sf_dir, "lang", "text"))


ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
k AS (SELECT lang, unnest(w) AS phrase, 1 AS k FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM w),
f AS (SELECT lang, phrase, k, count(*) AS n FROM k GROUP BY ALL),
n AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {LEAST}),
cut AS (SELECT *, unnest(range(1, k)) AS split FROM c),
sides AS (SELECT lang, phrase, k, a, split, array_to_string(w[1:split], ' ') AS first, array_to_string(w[split + 1:], ' ') AS rest FROM cut),
s AS (SELECT sides.lang, sides.phrase, sides.k, a, split, x.n AS l, y.n AS r, CAST((1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM sides JOIN f x ON x.lang = sides.lang AND x.phrase = first JOIN f y ON y.lang = sides.lang AND y.phrase = rest),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, split) = 1),
longer AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {PERCENT} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= {TOP}
"""
