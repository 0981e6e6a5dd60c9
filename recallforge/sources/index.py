"""A stored inverted index of memories: segments of postings with upper bounds, and exact top-k searches that prune by them.

A segment holds up to ``SEGMENT`` memories of a namespace.  Its postings are rows of ranges of terms (by a digest), so a
search reads the ranges of its own terms only; each term of a segment is a block with the bounds that its scores have
there: its largest count and its shortest text.  Building one is a map over the memories; appending adds segments.

A search takes the blocks of its terms out of the index once, sums their sizes to corpus statistics, and evaluates each
segment on its own.  There a query's terms are taken in the order of what they can give at most: once what is left can't
lift a memory to the query's threshold, only memories that are near it are looked up, and blocks that none of them needs
are not opened.  Thresholds come from a seed of segments and from the segment itself; they never drop a memory that could
be among the best.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.functions.wordbatch import TermBatches
from recallforge.sources.shared import Scratch, delete

# BM25 parameters.
K1, B = 1.5, 0.75
#: Memories of a segment, bytes of text that are indexed at once; ranges of terms, and terms from which a segment has them.
SEGMENT, SEGMENT_BYTES, RANGES, WHOLE = 4096, 8 << 20, 64, 8192
#: One in so many segments is evaluated first, to seed the thresholds; the rest of scores that rounding may hide.
SEED, HAIR = 8, 1e-5
_MEMORIES = "n long, tokens long, lengths binary"
_POSTINGS = "low int, high int, terms binary, size long, counts binary, most binary, least binary, places binary, tf binary"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def term_range(term: str, ranges: int) -> int:
    return zlib.crc32(term.encode()) % ranges


def packed(values: np.ndarray) -> bytes:
    """Integers under 2**32 as the planes of their bytes, compressed."""
    planes = values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def posting_rows(terms: list[str], numbers: np.ndarray, bounds: np.ndarray, n_ranges: int, whole: int) -> Iterator[dict]:
    """The columns of ``_POSTINGS`` of a segment, whose texts are ``numbers`` of sorted ``terms`` between ``bounds``."""
    if not terms:
        return
    length = np.diff(bounds)
    ranges = np.array([term_range(t, n_ranges) for t in terms]) if len(terms) > whole else np.zeros(len(terms), np.int64)
    order = np.argsort(ranges, kind="stable")
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    # by range, term and place; equal ones are one posting
    keys = np.sort(rank[numbers] << 32 | np.repeat(np.arange(len(length)), length))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    tf, of, place = np.diff(np.r_[first, len(keys)]), keys[first] >> 32, keys[first] & 0xFFFFFFFF
    cuts = np.searchsorted(of, np.arange(len(terms) + 1))
    counts, most, least = np.diff(cuts), np.maximum.reduceat(tf, cuts[:-1]), np.minimum.reduceat(length[place], cuts[:-1])
    step = np.diff(place, prepend=0)
    step[cuts[:-1]] = place[cuts[:-1]]
    by_range = ranges[order]
    edges = np.flatnonzero(np.r_[True, by_range[1:] != by_range[:-1]]).tolist()
    for a, b in zip(edges, [*edges[1:], len(terms)], strict=True):
        p, q = int(cuts[a]), int(cuts[b])
        names = "\n".join(terms[k] for k in order[a:b].tolist()).encode()
        low, high = (int(by_range[a]),) * 2 if len(terms) > whole else (0, n_ranges - 1)
        yield {"low": low, "high": high, "terms": pa.compress(names, codec="zstd", asbytes=True), "size": len(names), "counts": packed(counts[a:b]), "most": packed(most[a:b]), "least": packed(least[a:b]), "places": packed(step[p:q]), "tf": packed(tf[p:q])}


@dataclass
class Asked:
    """Queries of one search by number: their namespaces, their distinct terms, and how to score.

    A term that both have gives a memory ``bm25`` times its BM25, and ``share`` over the number of the query's terms.
    """

    namespaces: list[str]
    terms: list[list[str]]
    bm25: float = 1.0
    share: float = 0.0
    numbers: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.numbers = {t: k for k, t in enumerate(sorted({t for ts in self.terms for t in ts}))}

    def wanted(self) -> dict[str, list[str]]:
        """Sorted terms by namespace."""
        out: dict[str, set[str]] = defaultdict(set)
        for ns, ts in zip(self.namespaces, self.terms, strict=True):
            out[ns].update(ts)
        return {ns: sorted(ts) for ns, ts in out.items()}


@dataclass
class Statistics:
    """Of a namespace: its number of memories, their mean number of tokens, and how many each term is in."""

    count: int
    mean: float
    df: dict[int, int]

    def idf(self, k: int) -> float:
        df = self.df.get(k, 0)
        return float(np.log((self.count - df + 0.5) / (df + 0.5) + 1.0))


class Segment:
    """One segment at a search: its memories, and the blocks of the asked terms, opened when they are first needed."""

    def __init__(self, ids: list, lengths: np.ndarray, stats: Statistics):
        self.ids, self.stats = ids, stats
        self.blocks: dict[int, tuple[int, float, bytes, bytes]] = {}
        self.seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.norm = K1 * (1.0 - B + B * lengths / max(stats.mean, 1.0))

    def add(self, k: int, n: int, most: int, least: int, places: bytes, tf: bytes) -> None:
        bound = self.stats.idf(k) * most * (K1 + 1.0) / (most + K1 * (1.0 - B + B * least / max(self.stats.mean, 1.0)))
        self.blocks[k] = (n, bound, places, tf)

    def opened(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, BM25) of a block."""
        if k not in self.seen:
            places, tf = (np.frombuffer(x, np.int32) for x in self.blocks[k][2:])
            self.seen[k] = places, self.stats.idf(k) * tf * (K1 + 1.0) / (tf + self.norm[places])
        return self.seen[k]

    def evaluate(self, terms: list[int], weight: float, share: float, most: int | None, least: float, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, values) of memories with ``least`` or more that may be among the ``most`` best; all of them without ``most``."""
        here = sorted((-(weight * self.blocks[k][1] + share), k) for k in terms if k in self.blocks)
        rest = np.r_[np.cumsum([-b for b, _ in here][::-1])[::-1], 0.0]
        value = np.zeros(len(self.ids))
        done = 0
        while done < len(here) and rest[done] >= least - HAIR:
            places, scores = self.opened(here[done][1])
            value[places] += weight * scores + share
            done += 1
            if most is not None and done & (done - 1) == 0 and len(value) > most:  # now and then, as it costs a pass
                best = np.partition(value, len(value) - most)[len(value) - most]
                least = max(least, float(best) if best > 0 else least)
        near = np.flatnonzero((value > 0) & (value + rest[done] >= least - HAIR))
        for _, k in here[done:] if len(near) else ():
            places, scores = self.opened(k)
            at = np.minimum(np.searchsorted(places, near), len(places) - 1)
            held = places[at] == near
            value[near[held]] += weight * scores[at[held]] + share
        near = near[value[near] >= least - HAIR]
        found = np.round(value[near], digits)
        if most is not None and len(near) > most:
            keep = np.array(sorted(range(len(near)), key=lambda i: (-found[i], self.ids[near[i]]))[:most])
            near, found = near[keep], found[keep]
        return near, found


class TextIndex:
    """An index of memories at a path, of rows of memories and of postings."""

    def __init__(self, spark: SparkSession, path: str, id_type: str | None = None):
        """``id_type``, as ``bigint``, is read from the files where it is not given and there are any."""
        self.spark, self.path, self.id_type = spark, path, id_type

    def _schema(self) -> str:
        return f"kind string, namespace string, segment string, ids array<{self.id_type}>, {_MEMORIES}, {_POSTINGS}"

    @classmethod
    def build(cls, memories: DataFrame, path: str) -> TextIndex:
        """Indexes memories (id, namespace, content) at a new path; the namespace is ``default`` where there is none, null contents have no terms."""
        index = cls(memories.sparkSession, path, memories.schema["id"].dataType.simpleString())
        index.append(memories, "errorifexists")
        return index

    def append(self, memories: DataFrame, mode: str = "append") -> None:
        """Adds segments of more memories; an id that is there already would be found twice."""
        self.id_type = memories.schema["id"].dataType.simpleString()
        names = [(c.split()[0], _TYPES[c.split()[1]]) for c in f"{_MEMORIES}, {_POSTINGS}".split(", ")]

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, held, size, id_arrow = TermBatches(), {}, 0, pa.null()

            def segment(namespace: str, ids: list, texts: list) -> pa.RecordBatch:
                terms, numbers, bounds = encoder.encode(texts)
                length, name = np.diff(bounds), uuid.uuid4().hex
                rows = [{"kind": "memories", "ids": ids, "n": len(ids), "tokens": int(length.sum()), "lengths": packed(length)}]
                rows += [{"kind": "postings", **row} for row in posting_rows(terms, numbers, bounds, RANGES, WHOLE)]
                types = [("kind", pa.string()), ("namespace", pa.string()), ("segment", pa.string()), ("ids", pa.list_(id_arrow)), *names]
                return pa.RecordBatch.from_pylist([{"namespace": namespace, "segment": name, **row} for row in rows], pa.schema(types))

            def flushed() -> Iterator[pa.RecordBatch]:
                for namespace, (ids, texts) in held.items():
                    for a in range(0, len(ids), SEGMENT):
                        yield segment(namespace, ids[a : a + SEGMENT], texts[a : a + SEGMENT])
                held.clear()

            for whole in batches:
                id_arrow = whole.column("id").type
                for a in range(0, whole.num_rows, 512):
                    for namespace, id_, text in zip(*(whole.slice(a, 512).column(c).to_pylist() for c in ("namespace", "id", "content")), strict=True):
                        ids, texts = held.setdefault(namespace, ([], []))
                        ids.append(id_)
                        texts.append(text)
                        size += len(text or "")
                        if size >= SEGMENT_BYTES:  # after each text, as some are long
                            yield from flushed()
                            size = 0
            yield from flushed()

        namespace = F.coalesce("namespace", F.lit("default")) if "namespace" in memories.columns else F.lit("default")
        memories.select("id", namespace.alias("namespace"), "content").mapInArrow(made, self._schema()).write.mode(mode).partitionBy("kind").parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)

    def _rows(self, kind: str, asked: Asked) -> DataFrame:
        reader = self.spark.read.schema(self._schema()) if self.id_type else self.spark.read
        rows = reader.parquet(self.path).filter((F.col("kind") == kind) & F.col("namespace").isin(sorted(set(asked.namespaces))))
        if kind == "postings":
            ranges = sorted({term_range(t, RANGES) for t in asked.numbers})
            if len(ranges) <= RANGES // 2:  # else all rows have some
                held = F.lit(False)
                for r in ranges:
                    held = held | ((F.col("low") <= r) & (F.col("high") >= r))
                rows = rows.filter(held)
        return rows

    def blocks(self, asked: Asked) -> DataFrame:
        """(namespace, segment, k, n, most, least, places, tf): the blocks of the asked terms in their namespaces."""
        sent = self.spark.sparkContext.broadcast((asked.wanted(), asked.numbers))
        schema = "namespace string, segment string, k int, n long, most long, least long, places binary, tf binary"
        types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        names = [c.split()[0] for c in schema.split(", ")]

        def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, numbers = sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    terms = pa.decompress(row["terms"], row["size"], codec="zstd", asbytes=True).decode().split("\n")
                    found = []
                    for t in wanted[row["namespace"]]:
                        if row["low"] <= term_range(t, RANGES) <= row["high"] and (at := bisect_left(terms, t)) < len(terms) and terms[at] == t:
                            found.append((at, numbers[t]))
                    if found:
                        counts, most, least, step, tf = (unpacked(row[c]) for c in ("counts", "most", "least", "places", "tf"))
                        ends, out = np.cumsum(counts), []
                        for at, k in found:
                            a, b = int(ends[at] - counts[at]), int(ends[at])
                            out.append((row["namespace"], row["segment"], k, b - a, int(most[at]), int(least[at]), np.cumsum(step[a:b]).astype(np.int32).tobytes(), tf[a:b].astype(np.int32).tobytes()))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        return self._rows("postings", asked).select("namespace", "segment", *(c.split()[0] for c in _POSTINGS.split(", "))).mapInArrow(taken, schema)

    def search(self, asked: Asked, scratch: Scratch) -> IndexSearch:
        """Takes the blocks of the queries' terms out of the index, and sums up their statistics."""
        blocks = scratch.table(self.blocks(asked), "blocks")
        memories = self._rows("memories", asked)
        stats = {r.namespace: Statistics(r.n, r.tokens / r.n, {}) for r in memories.groupBy("namespace").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect()}  # the queries' own
        for r in blocks.groupBy("namespace", "k").agg(F.sum("n").alias("n")).collect():  # the queries' own terms
            stats[r.namespace].df[r.k] = r.n
        return IndexSearch(asked, blocks, memories.select("namespace", "segment", "ids", "lengths"), stats)


class IndexSearch:
    """Queries with the blocks of their terms and the statistics of their namespaces."""

    def __init__(self, asked: Asked, blocks: DataFrame, memories: DataFrame, stats: dict[str, Statistics]):
        self.asked, self.blocks, self.memories, self.stats = asked, blocks, memories, stats

    def _evaluated(self, where: str, most: int | None, least: list[float], digits: int) -> DataFrame:
        """(q, id, value, held, opened): rows of memories, and with q = -1 how many postings of how many a segment has opened."""
        asked, stats = self.asked, self.stats
        sent = self.blocks.sparkSession.sparkContext.broadcast((asked, stats, least))
        element = self.memories.schema["ids"].dataType.elementType
        schema = f"q int, id {element.simpleString()}, value double, held long, opened long"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, known, bounds = sent.value
            by_namespace: dict[str, list[tuple[int, list[int], float]]] = defaultdict(list)
            for q, (ns, terms) in enumerate(zip(own.namespaces, own.terms, strict=True)):
                by_namespace[ns].append((q, [own.numbers[t] for t in terms], own.share / max(len(terms), 1)))
            id_type = pa.null()

            def results(namespace: str, segment: Segment) -> pa.RecordBatch:
                qs, ids, values = [], [], []
                for q, terms, share in by_namespace[namespace]:
                    places, found = segment.evaluate(terms, own.bm25, share, most, bounds[q], digits)
                    qs += [q] * len(places)
                    ids += [segment.ids[p] for p in places.tolist()]
                    values += found.tolist()
                held = [0] * len(qs) + [sum(b[0] for b in segment.blocks.values())]
                opened = [0] * len(qs) + [sum(segment.blocks[k][0] for k in segment.seen)]
                return pa.RecordBatch.from_arrays([pa.array([*qs, -1], pa.int32()), pa.array([*ids, None], id_type), pa.array([*values, None], pa.float64()), pa.array(held, pa.int64()), pa.array(opened, pa.int64())], names=["q", "id", "value", "held", "opened"])

            key = segment = None
            for batch in batches:
                id_type = batch.column("ids").type.value_type
                for i in range(batch.num_rows):
                    ns, name, k = (batch.column(c)[i].as_py() for c in ("namespace", "segment", "k"))
                    if (ns, name) != key:
                        if segment is not None and segment.blocks:
                            yield results(key[0], segment)
                        key, segment = (ns, name), None
                    if k < 0:  # a segment's memories come before its blocks
                        segment = Segment(batch.column("ids")[i].as_py(), unpacked(batch.column("lengths")[i].as_py()), known[ns])
                    else:
                        segment.add(k, *(batch.column(c)[i].as_py() for c in ("n", "most", "least", "places", "tf")))
            if segment is not None and segment.blocks:
                yield results(key[0], segment)

        memories = self.memories.withColumn("k", F.lit(-1))
        rows = memories.unionByName(self.blocks, allowMissingColumns=True).filter(where)
        dealt = rows.repartition("namespace", "segment").sortWithinPartitions("namespace", "segment", "k")
        return dealt.mapInArrow(run, schema)

    def best(self, most: int, scratch: Scratch, digits: int = 6) -> DataFrame:
        """(q, id, value): what may be among the ``most`` best of a query, ties by id, of memories that share a term with it."""
        first, other = f"pmod(xxhash64(segment), {SEED}) = 0", f"pmod(xxhash64(segment), {SEED}) <> 0"
        seed = scratch.table(self._evaluated(first, most, [0.0] * len(self.asked.terms), digits), "seed")
        least = [0.0] * len(self.asked.terms)
        # the seed has at most so many of each query from a segment; one row a query comes back
        for r in seed.filter("q >= 0").groupBy("q").agg(F.sort_array(F.collect_list("value"), asc=False).alias("v")).filter(F.size("v") >= most).select("q", F.col("v")[most - 1].alias("least")).collect():
            least[r.q] = r.least
        return seed.unionByName(self._evaluated(other, most, least, digits))

    def above(self, least: list[float]) -> DataFrame:
        """(q, id, value): all memories that share a term with a query and have its ``least`` or more."""
        return self._evaluated("true", None, least, 6).filter("q >= 0")
