"""Merges on write in parallel: only memories that can meet are replayed in order.

A row joins the first memory that it matches, and a match depends on what was merged before, so rows are replayed in the
order in which they came.  But rows that never match each other can be replayed apart.  Equal sets of tokens are one node;
nodes whose sets overlap enough, found by pairs of their rarest tokens, are linked, and each component is replayed on its own.
Merging makes new sets, which may match rows of other components: those that do link their components, which alone are
replayed once more, until no memory of a component ever matches a row of another one.  By induction over the rows this is what one
replay of all would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from recallforge.functions.wordbatch import TermBatches
from recallforge.operators.graph import components
from recallforge.sources.shared import Scratch

#: Sets of one key that are compared in one place; more are dealt into blocks, and each pair of blocks is.  Places of up
#: to so many rows are compared all at once; rows of memories that are given at once.
BLOCK, SHORT, GIVEN = 1024, 64, 2048
#: The most tokens of a set that is found by two of them at once; the most tokens whose frequency is known.
PAIRED, OFTEN = 64, 1 << 16
#: Words whose stems a task remembers.
STEMS = 1 << 18


def with_tokens(rows: DataFrame, text: str, space: list[str]) -> DataFrame:
    """``rows`` with ``tokens``, sorted digests of the distinct stems of ``text`` in their space, and ``node``, a digest of
    them; of a text without any, of the text itself in lower case."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, terms array<string>"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TermBatches(STEMS)
        for batch in batches:
            distinct, numbers, bounds = known.encode(batch.column(text).to_pylist())
            n = max(len(distinct), 1)
            each = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(bounds)) * n + numbers)
            offsets = np.searchsorted(each, np.arange(batch.num_rows + 1) * n)
            terms = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(distinct, pa.string()).take(pa.array(each % n)))
            yield pa.RecordBatch.from_arrays([*batch.columns, terms], names=[*batch.schema.names, "terms"])

    found = rows.mapInArrow(made, schema)
    digests = F.array_sort(F.transform("terms", lambda t: F.xxhash64(*space, t)))
    node = F.when(F.size("terms") > 0, F.xxhash64(*space, digests)).otherwise(F.xxhash64(*space, F.lower(F.coalesce(text, F.lit(""))), F.lit("text")))
    return found.withColumn("tokens", digests).withColumn("node", node).drop("terms")


def _mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Digests of pairs of numbers."""
    h = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) + (b.view(np.uint64) if isinstance(b, np.ndarray) else np.uint64(b))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def _keys(offsets: np.ndarray, flat: np.ndarray, often: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): digests under which any two sets that overlap by ``least`` meet.

    In one order for all sets, here rarest tokens first, two sets that share ``t`` tokens share ``k`` of those that are left
    of each without its last ``t - k``.  Sets of up to PAIRED tokens meet under two such tokens at once, which few sets have
    in common however many there are; those that may share a single one, and those that may meet longer ones, under one.
    """
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    place = np.searchsorted(often[0], flat)
    place[place == len(often[0])] = 0
    df = np.where(often[0][place] == flat, often[1][place], 0) if len(often[0]) else np.zeros(len(flat), np.int64)
    tokens = flat[np.lexsort((flat, df, row))]
    starts = offsets[:-1] - offsets[0]
    shared = np.ceil(least * size - 1e-9).astype(np.int64)
    rows, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    first = np.where((size > 0) & ((shared <= 1) | (size >= int(least * PAIRED))), np.minimum(size, size - shared + 1), 0)
    at = np.repeat(np.arange(len(size)), first)
    rows.append(at)
    keys.append(_mixed(tokens[np.repeat(starts - (np.cumsum(first) - first), first) + np.arange(len(at))], 1))
    first = np.where((size > 1) & (size <= PAIRED), np.minimum(size, size - shared + 2), 0)
    for n in np.unique(first[first > 1]).tolist():
        of, (i, j) = np.flatnonzero(first == n), np.triu_indices(n, 1)
        mine = tokens[starts[of][:, None] + np.arange(n)]
        rows.append(np.repeat(of, len(i)))
        keys.append(_mixed(mine[:, i].ravel(), mine[:, j].ravel()))
    return np.concatenate(rows), np.concatenate(keys)


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that have over one in OFTEN of all places in ``sets``, so fewer than OFTEN, in order, and in how many sets
    they are; all others count as equally rare."""
    per = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    places = sets.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n")).first().n
    found = per.filter(F.col("df") > places / OFTEN).orderBy("token").toPandas()
    return found["token"].to_numpy(np.int64), found["df"].to_numpy(np.int64)


def _keyed(sets: DataFrame, often: Broadcast, least: float) -> DataFrame:
    """(node, key) of ``_keys``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, lists = batch.column("node").to_numpy(), batch.column("tokens")
            for a in range(0, len(node), GIVEN):
                part = lists.slice(a, GIVEN)
                offsets = part.offsets.to_numpy().astype(np.int64)
                row, key = _keys(offsets, part.values.to_numpy()[offsets[0] : offsets[-1]], often.value, least)
                yield pa.RecordBatch.from_arrays([pa.array(node[a : a + GIVEN][row]), pa.array(key)], names=["node", "key"])

    return sets.filter("size(tokens) > 0").select("node", "tokens").mapInArrow(made, "node long, key long")


def _pairs(a: list[np.ndarray], b: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of sets of ``a`` and ``b`` that overlap by ``least``; by counts of shared tokens, all at once."""
    size_a, size_b = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    tokens, code = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    of_a, of_b = code[: size_a.sum()], code[size_a.sum() :]
    order = np.argsort(of_b, kind="stable")
    in_b = np.repeat(np.arange(len(b)), size_b)[order]
    first, last = (np.searchsorted(of_b[order], np.arange(len(tokens)), side) for side in ("left", "right"))
    found_a, found_b, starts = [], [], np.cumsum(size_a) - size_a
    for i in range(len(a)):
        mine = of_a[starts[i] : starts[i] + size_a[i]]
        both = np.bincount(np.concatenate([in_b[first[t] : last[t]] for t in mine.tolist()] or [in_b[:0]]), minlength=len(b))
        hit = np.flatnonzero((both > 0) & (both >= least * (size_a[i] + size_b - both)))
        found_a.append(np.full(len(hit), i))
        found_b.append(hit)
    return np.concatenate(found_a), np.concatenate(found_b)


def _matches(place: np.ndarray, side: np.ndarray, node: np.ndarray, offsets: np.ndarray, flat: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of sides 0 and 1 of a place whose sets overlap by ``least``; if ``same`` only those with the smaller node first.

    Rows are sorted by place and side; small places are compared all at once, by shifts.
    """
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    sizes, length = np.diff(np.r_[starts, len(place)]), np.diff(offsets)
    out_i, out_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for s, n in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
        ones = s + int((side[s : s + n] == 0).sum())
        if s < ones < s + n:
            i, j = _pairs([flat[offsets[k] : offsets[k + 1]] for k in range(s, ones)], [flat[offsets[k] : offsets[k + 1]] for k in range(ones, s + n)], least)
            out_i.append(s + i)
            out_j.append(ones + j)
    at, step, near_i, near_j = np.flatnonzero(np.repeat(sizes <= SHORT, sizes) & (side == 0)), 1, [], []
    while len(at):
        at = at[at + step < len(place)]
        at = at[place[at + step] == place[at]]
        to = at + step
        small, large = np.minimum(length[at], length[to]), np.maximum(length[at], length[to])
        fits = (side[to] == 1) & (small >= least * large) & ((node[at] < node[to]) if same else True)
        near_i.append(at[fits])
        near_j.append(to[fits])
        step += 1
    i, j = (np.concatenate([np.empty(0, np.int64), *x]) for x in (near_i, near_j))
    for a in range(0, len(i), 20_000):
        x, y = i[a : a + 20_000], j[a : a + 20_000]
        size = np.r_[length[x], length[y]]
        owner = np.repeat(np.r_[np.arange(len(x)), np.arange(len(x))], size)
        tokens = flat[np.repeat(np.r_[offsets[x], offsets[y]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        order = np.lexsort((tokens, owner))
        owner, tokens = owner[order], tokens[order]
        both = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (tokens[1:] == tokens[:-1])], minlength=len(x))
        hit = (both > 0) & (both >= least * (length[x] + length[y] - both))
        out_i.append(x[hit])
        out_j.append(y[hit])
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    keep = node[i] < node[j] if same else np.ones(len(i), bool)
    return i[keep], j[keep]


def overlapping(left: DataFrame, right: DataFrame, least: float, same: bool = False, often: tuple[np.ndarray, np.ndarray] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(a, b): nodes of ``left`` and ``right`` (node, tokens) whose sets overlap by ``least``; distinct, in both orders if ``same``.

    Sets meet under their keys; a key of very many sets is dealt into blocks, each pair of which meets in one place, so no
    task holds more than two blocks.  ``often`` are the ``frequent`` tokens of ``right``, where these are known; with
    ``scratch`` the keys that sets share are found once and written.
    """
    written = scratch.table if scratch else lambda df, _: df
    known = left.sparkSession.sparkContext.broadcast(frequent(right) if often is None else often)
    mine = _keyed(left, known, least)
    # a key that no other set is under can't give a pair
    if same:
        held = written(mine.withColumn("n_right", F.count("*").over(Window.partitionBy("key"))).filter("n_right > 1"), "keys")
        mine = theirs = held.withColumn("n_left", F.col("n_right"))
    else:
        theirs = _keyed(right, known, least)
        lefts = mine.groupBy("key").agg(F.count("*").alias("n_left"))
        theirs = written(theirs.join(lefts, "key").withColumn("n_right", F.count("*").over(Window.partitionBy("key"))), "keys")
        mine = mine.join(theirs.groupBy("key").agg(F.first("n_right").alias("n_right"), F.first("n_left").alias("n_left")), "key")

    def dealt(rows: DataFrame, sets: DataFrame, side: int) -> DataFrame:
        own, other = ("n_left", "n_right") if side == 0 else ("n_right", "n_left")
        out = rows.withColumn("own", F.expr(f"pmod(xxhash64(node, key), cast(ceil({own} / {BLOCK}) as int))")).withColumn("other", F.explode(F.expr(f"sequence(0, cast(ceil({other} / {BLOCK}) as int) - 1)")))
        place = F.xxhash64("key", F.col("own") if side == 0 else F.col("other").cast("long"), F.col("other").cast("long") if side == 0 else F.col("own"))
        return out.select("node", place.alias("place"), F.lit(side).alias("side")).join(sets.select("node", "tokens"), "node")

    rows = dealt(mine, left, 0).unionByName(dealt(theirs, right, 1))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def found(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            place, side, node = (part.column(c).to_numpy() for c in ("place", "side", "node"))
            lists = part.column("tokens").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            i, j = _matches(place, side, node, offsets, flat, least, same)
            return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            place = table.column("place").to_numpy()
            cut = int(np.searchsorted(place, place[-1]))
            if cut:
                yield found(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield found(held)

    ordered = rows.select("place", "side", "node", "tokens").repartition("place").sortWithinPartitions("place", "side", "node")
    pairs = ordered.mapInArrow(stream, "a long, b long").distinct()
    return pairs.unionByName(pairs.selectExpr("b a", "a b")) if same else pairs.filter("a <> b")


def replayed(rows: DataFrame, by: list[str], pool, least: float, schema: str) -> DataFrame:
    """Rows of components replayed in the order of (seq, content), one component at a time: memories as in ``schema``, and
    rows with ``state`` only, the sets of tokens that merging has made.

    ``by`` ends with the component's ``root``; without one, whole groups are replayed, and their sets are not given.
    """
    rooted = by[-1] == "root"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    out_schema = f"{schema}, root long, state array<string>"
    arrow = to_arrow_schema(StructType.fromDDL(out_schema))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, None, []

        def done() -> None:
            out.extend({**{n: r.get(n) for n in names}, "metadata": None if r["metadata"] is None else list(r["metadata"].items()), "root": key[-1] if rooted else None} for r in held.rows)
            out.extend({"namespace": key[0], "memory_type": key[1], "root": key[-1], "state": sorted(s)} for s in (held.made if rooted else ()))

        for batch in batches:
            for row in batch.to_pylist():
                k = tuple(row[c] for c in by)
                if k != key:
                    if held is not None:
                        done()
                    if len(out) >= GIVEN:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out = []
                    key, held = k, pool(least)
                held.add({**row, "metadata": None if row["metadata"] is None else dict(row["metadata"])})
        if held is not None:
            done()
        yield pa.RecordBatch.from_pylist(out, arrow)

    ordered = rows.repartition(*by).sortWithinPartitions(*by, "seq", "content")
    return ordered.mapInArrow(stream, out_schema)


def merge_components(rows: DataFrame, least: float, pool, schema: str, scratch: Scratch) -> DataFrame:
    """What one replay of all ``rows`` in each (namespace, memory_type) gives, by components; ``pool`` replays one.

    The memories as in ``schema``, with ``root`` and ``state`` of ``replayed``; a plan over tables of ``scratch``.
    """
    space, names = ["namespace", "memory_type"], [f.split(" ")[0] for f in schema.split(", ")]
    rows = scratch.table(with_tokens(rows, "content", space), "rows")
    nodes = scratch.table(rows.groupBy("node").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n")), "nodes")
    often = frequent(nodes)
    links = scratch.table(overlapping(nodes, nodes, least, same=True, often=often, scratch=scratch), "links")
    # most rows are alone in their component: they are memories as they are
    linked = components(links, scratch).selectExpr("id node", "root")
    where = scratch.table(linked.unionByName(nodes.filter("n > 1").join(linked, "node", "left_anti").selectExpr("node", "node root")), "where")
    changed, done = where, None
    while True:
        several = rows.drop("tokens").join(changed, "node").drop("node")
        new = scratch.table(replayed(several, [*space, "root"], pool, least, schema), "memories")
        done = new if done is None else scratch.table(done.unionByName(new), "memories")
        made = new.filter("state is not null").select("root", F.array_sort(F.transform("state", lambda t: F.xxhash64(*space, t))).alias("tokens"))
        made = scratch.table(made.withColumn("node", F.xxhash64("root", "tokens", F.lit("made"))).dropDuplicates(["node"]), "made")
        met = overlapping(made.select("node", "tokens"), nodes, least, often=often, scratch=scratch)
        # only matches between components matter
        other = met.join(where.selectExpr("node b", "root other"), "b", "left").withColumn("other", F.coalesce("other", "b"))
        across = other.join(made.selectExpr("node a", "root"), "a").filter("root <> other")
        across = scratch.table(across.selectExpr("root a", "other b").distinct(), "across")
        if across.isEmpty():
            alone = rows.join(where, "node", "left_anti").withColumns({"merged": F.lit(1).cast("long"), "root": F.col("node"), "state": F.lit(None).cast("array<string>")})
            return done.unionByName(alone.select(*names, "root", "state"))
        # components that met are one now, and are replayed again; a node that was alone was a component of its own
        joined = components(across, scratch).selectExpr("id was", "root next")
        came = joined.join(where.selectExpr("root was").distinct(), "was", "left_anti").selectExpr("was node", "next root")
        moved = where.withColumnRenamed("root", "was").join(joined, "was")
        changed = scratch.table(moved.selectExpr("node", "next root").unionByName(came), "changed")
        where = scratch.table(where.join(changed, "node", "left_anti").unionByName(changed), "where")
        done = done.join(joined.selectExpr("was root"), "root", "left_anti").select(*done.columns)
