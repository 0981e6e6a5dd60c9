"""Op 12, SimHash near-dedup: deletion-variant signatures of few segments, an equality join, verified links.

Two fingerprints of at most ``BITS`` = 4 differing bits, cut into three segments, differ by one bit at most in one of
them.  Each fingerprint is indexed under every segment with each one of its bits left out (a wildcard): 64 keys.  Two
fingerprints that differ in that bit alone, or not at all, there have the same key, so all links meet under a key, where
they are verified on the whole fingerprints.

Equal fingerprints are one row of all this.  A bucket of up to ``SMALL`` fingerprints is compared in one place, and gives
a spanning set of its links only.  A larger bucket is first dealt into blocks, anew under each of its keys, so that the
copies that made it large are united; what still is in several components is branched once more by variants of the bits
that the key doesn't hold, cut into three segments again (they differ by four bits at most, too).  After ``LEVELS``
levels a bucket leaves 19 bits and three wildcards open, so at most 2**22 fingerprints, 32 MB, can be in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, documents, mix, slices
from .near_dups import LOWER, components

WORDS, BITS, SEED, SMALL, LEVELS = 4, 4, 42, 4096, 3
#: Runs of up to so many fingerprints are compared all at once, by shifts.
SHORT = 32
_ALL = (1 << 64) - 1


def shingle_hashes(text: str | None, n: int) -> list[int]:
    """XXH64 of a text's shingles of ``n`` words, repeats included; of the whole sequence where it is shorter."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return []
    joined, n = b" ".join(words), min(n, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - n + 1].tolist()
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[str | None], n: int = WORDS, block: int = 1 << 16) -> np.ndarray:
    """A fingerprint (uint64) of each text: a bit is 1 if it is set in over half of the shingles' hashes."""
    hashes = [np.array(shingle_hashes(t, n), np.uint64) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    owner, every = np.repeat(np.arange(len(texts)), sizes), np.concatenate([*hashes, np.empty(0, np.uint64)])
    ones = np.zeros((len(texts), 64), np.int64)
    for a in range(0, len(every), block):
        own = owner[a : a + block]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        bits = np.unpackbits(every[a : a + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def segments(rest: int) -> list[int]:
    """Masks of three segments of the bits of ``rest``."""
    bits = [i for i in range(64) if rest >> i & 1]
    cuts = [len(bits) * k // 3 for k in range(4)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(rest: int) -> list[tuple[int, int]]:
    """(bits that the key holds, bits left) of each one-wildcard variant of each segment of ``rest``."""
    return [(seg & ~(1 << i), rest & ~seg) for seg in segments(rest) for i in range(64) if seg >> i & 1]


def branched(rows: DataFrame) -> DataFrame:
    """Rows (key, mask, rest, fp) under all variants of the bits of ``rest``; keys are digests, as links are verified."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 8192):
                key, rest, fp = (whole.slice(a, 8192).column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "rest", "fp"))
                out = []
                for r in np.unique(rest).tolist():
                    k, f = key[rest == r], fp[rest == r]
                    for mask, left in variants(r):
                        held = mix(mix(k + np.uint64(mask)) ^ (f & np.uint64(mask)))
                        out.append((held, np.full(len(f), mask, np.uint64), np.full(len(f), left, np.uint64), f))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*out, strict=True)], names=["key", "mask", "rest", "fp"])

    return rows.select("key", "rest", "fp").mapInArrow(each, "key long, mask long, rest long, fp long")


def spanning(fp: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning set of the links of one bucket: what is linked already is not compared again."""
    left, waiting, a, b = np.arange(1, len(fp)), [0], [], []
    while len(left):
        i = waiting.pop() if waiting else None
        if i is None:
            i, left = int(left[0]), left[1:]
        near = np.bitwise_count(fp[left] ^ fp[i]) <= bits
        if near.any():
            hit = left[near]
            left = left[~near]
            waiting += hit.tolist()
            a.append(np.full(len(hit), fp[i]))
            b.append(fp[hit])
    return a, b


def first_mask(x: np.ndarray) -> np.ndarray:
    """Of fingerprints that differ in the bits ``x``: the mask of the first key that both have."""
    out = np.zeros(len(x), np.uint64)
    for seg in segments(_ALL):
        seg = np.uint64(seg)
        own = x & seg
        low = np.where(own == 0, seg & (~seg + np.uint64(1)), own)
        out = np.where((out == 0) & (np.bitwise_count(own) <= 1), seg & ~low, out)
    return out


def bucket_links(key: np.ndarray, mask: np.ndarray, fp: np.ndarray, bits: int, once: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) within the runs of equal keys: all of short runs, a spanning set of longer ones.

    With ``once``, a link of a short run is given only under the first key that both ends have.
    """
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    short, a, b = np.repeat(sizes <= SHORT, sizes), [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for s, n in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
        u, v = spanning(fp[s : s + n], bits)
        a += u
        b += v
    at, step = np.flatnonzero(short), 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at + step] == key[at]]
        x = fp[at] ^ fp[at + step]
        near = np.bitwise_count(x) <= bits
        if once:
            near[near] = first_mask(x[near]) == mask[at[near]]
        a.append(fp[at[near]])
        b.append(fp[at[near] + step])
        step += 1
    return np.concatenate(a), np.concatenate(b)


def compared(rows: DataFrame, bits: int, once: bool, most: int | None) -> DataFrame:
    """(a, b, key, rest, fp, root): links (a, b) within the buckets of rows (key, mask, rest, fp, root), and the rows of
    buckets of over ``most`` fingerprints, which pass through.

    One bucket of up to ``most`` is held at a time.  Buckets of one ``root``, where it is not null, have no links that matter.
    """
    names, out_names = ("key", "mask", "rest", "fp", "root"), ("a", "b", "key", "rest", "fp", "root")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, held, passing = np.empty((5, 0), np.uint64), np.empty((5, 0), np.uint64), None

        def result(links: tuple[np.ndarray, np.ndarray], large: np.ndarray) -> pa.RecordBatch:
            pad = [pa.nulls(len(links[0]), pa.int64())] * 4
            of_links = [pa.array(x.view(np.int64)) for x in links] + pad
            of_rows = [pa.nulls(large.shape[1], pa.int64())] * 2 + [pa.array(np.ascontiguousarray(large[i]).view(np.int64)) for i in (0, 2, 3, 4)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(of_links, of_rows, strict=True)], names=list(out_names))

        def done(part: np.ndarray) -> pa.RecordBatch:
            """Of whole buckets."""
            key, root = part[0], part[4]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(key)])
            large = sizes > most if most is not None else np.zeros(len(sizes), bool)
            several = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts) if len(key) else large
            large, small = np.repeat(large, sizes), np.repeat(~large & several, sizes)
            return result(bucket_links(key[small], part[1][small], part[3][small], bits, once), part[:, large])

        for batch in batches:
            part = np.stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in names]) if batch.num_rows else none
            if passing is not None:
                n = int((part[0] == passing).sum())
                yield result((none[0], none[0]), part[:, :n])
                part = part[:, n:]
                passing = passing if not part.shape[1] else None
            if not part.shape[1]:
                continue
            part = np.concatenate([held, part], axis=1)
            cut = int(np.searchsorted(part[0].view(np.int64), part[0].view(np.int64)[-1]))
            yield done(part[:, :cut])
            held = part[:, cut:]
            if most is not None and held.shape[1] > most:
                passing = held[0][0]
                yield result((none[0], none[0]), held)
                held = none
        yield done(held)

    dealt = rows.select(*names).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(stream, ", ".join(f"{c} long" for c in out_names))


def linked(classes: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """(id, root) of the distinct fingerprints ``fp`` that are linked with another one."""
    rows, edges = branched(classes.selectExpr("0L key", "-1L rest", "fp")).withColumn("root", F.col("fp")), None
    for level in range(LEVELS):
        last = level + 1 == LEVELS
        found = scratch.table(compared(rows, bits, not level, None if last else SMALL), f"compared{level}")
        large = found.filter("a is null").select("key", "rest", "fp", "root")
        more = not last and not large.isEmpty()
        new = found.filter("a is not null").select("a", "b")
        if more:
            # dealt into blocks anew under each key, so that groups of copies are united before they are branched
            sizes = large.groupBy("key").agg(F.expr(f"cast(ceil(count(*) / {SMALL}) as int)").alias("blocks"))
            dealt = large.join(sizes, "key").withColumn("key", F.expr("xxhash64(key, pmod(xxhash64(fp, key, 'block'), blocks))"))
            new = new.unionByName(compared(dealt.withColumn("mask", F.lit(0).cast("long")), bits, False, None).filter("a is not null").select("a", "b"))
        new = scratch.table(new.distinct(), f"links{level}")
        edges = new if edges is None else edges.unionByName(new)
        parts = components(edges, scratch)
        if not more:
            return parts
        parts = scratch.table(parts, f"parts{level}")
        rooted = scratch.table(large.drop("root").join(parts.selectExpr("id fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), f"rooted{level}")
        # what is left are buckets of several components
        open_ = rooted.groupBy("key").agg(F.min("root").alias("u"), F.max("root").alias("v")).filter("u <> v").select("key")
        roots = rooted.select("fp", "root").distinct()
        rows = branched(rooted.join(open_, "key").select("key", "rest", "fp")).join(roots, "fp")
    return parts


def simhash_components(docs: DataFrame, n: int = WORDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Words are split at ASCII white space, A-Z in lower case; the fingerprint is of the XXH64 (seed 42) of the shingles of
    ``n`` words, repeats included, as 16 hexadecimal digits; with fewer words the whole sequence is one shingle; null,
    empty and blank texts have fingerprint zero, which is linked like any other.  Fingerprints are linked at ``bits`` or
    fewer differing bits (four at most); a component has the smallest id that links reach.  Rows with a null id are each
    their own component, with a null component id; repeated rows of an id are returned each, and all their texts are the
    document's.  Other columns are not read.
    """
    if not 0 <= bits <= 4:
        raise ValueError("three segments find up to four differing bits")
    scratch = Scratch(docs.sparkSession, "simhash")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                fp = fingerprints(batch.column("text").to_pylist(), n)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    prints = scratch.lasting(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(made, "doc_id long, fp long"), "prints")
    named = prints.filter("doc_id is not null")
    # texts of one id are one document: they share its component
    several = named.distinct().groupBy("doc_id").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).filter("size(all) > 1")
    same = several.select("a", F.explode("all").alias("b")).filter("a <> b")
    classes = scratch.table(named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    roots = scratch.table(linked(classes.select("fp"), bits, scratch), "roots")
    same = scratch.table(same, "same")
    if not same.isEmpty():
        stars = roots.filter("id <> root").selectExpr("id a", "root b").unionByName(same)
        roots = scratch.table(components(stars, scratch), "roots2")
    rooted = classes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = scratch.table(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    # only classes of several documents, or linked ones, differ from their own id: few rows meet in the join
    moved = scratch.lasting(rooted.join(least, "root").filter("copies > 1 or component_id <> rep").select("fp", "component_id"), "moved")
    scratch.drop()
    out = prints.join(moved, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by fingerprints; null, blank and very long texts, and repeated rows, as in ``simhash_components``."""
    return simhash_components(documents(spark, sf_dir, "doc_id", "text"))
