"""Op 2, MinHash near-dedup: a chosen-path set similarity join, exact links, connected components.

Equal sets are one class.  Over the classes, independent trees branch documents by minwise tokens: a tree's node is
the run of minimal hashes chosen so far, and a node with more than ``small`` classes is branched by the tree's next
hash function (the first tokens of its path stay those of its parent).  Small nodes are compared exhaustively, and
nodes that are still large when a tree ends in blocks and each with the first class of the node, by signatures; what
may be linked there forms candidate groups.  Within a candidate group links are confirmed on the full sets: blocks of
bounded size are compared exhaustively; in a group of several blocks the members outside its largest part meet all
blocks, first one of each part and then those that are still outside.

A pair of similarity 0.85 agrees in one minwise token with probability 0.85 and shares a leaf of depth d of one tree
with 0.85**d at least; with 16 trees of depth up to 4 the chance to miss it is under 1e-5, and under 1e-12 where nodes
are small at once, as they are for all but large groups, whose members are linked through many others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, documents, gram_hashes, materialize, mix, sequence_hash, sieve, slices, word_hashes

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Trees and their depth; classes in a small node; classes and shingles in a block; members of a group that meet a block in one task.
TREES, DEPTH, SMALL, BLOCK, BLOCK_SHINGLES, ASKED = 16, 4, 64, 256, 1_500_000, 2048
_N = TREES * DEPTH
with np.errstate(over="ignore"):
    _MUL = mix(np.arange(1, _N + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct digests of a text's shingles of ``n`` words in ASCII lower case; see ``near_duplicates``."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return np.unique(gram_hashes(h, min(n, len(h))))


def signature(s: np.ndarray) -> np.ndarray:
    """Minimal hashes under ``TREES * DEPTH`` functions, 32 bits each."""
    best = np.full(_N, 0xFFFFFFFF, np.uint64)
    for a in range(0, len(s), 4096):
        part = s[a : a + 4096]
        best = np.minimum(best, ((part[:, None] * _MUL[None, :]) >> np.uint64(32)).min(0))
    return best.astype(np.uint32)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Parts:
    """Union-find; roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def sets_table(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, key of the set, signature)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
                key = [f"{sequence_hash(s):x}:{int(np.add.reduce(s)):x}:{len(s)}" if len(s) else None for s in sets]
                sig = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.string()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "key", "sig"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(made, "doc_id long, n_shingles long, key string, sig binary")


def tree_nodes(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Small nodes with their classes, and the large nodes of the last level: (node, rep) each.

    Small nodes that hold the same classes, as those of one pair in most trees, get the same name.  A level is written
    as (node, rep, tree) only; nodes of one class go before the join that would shuffle them.
    """
    word = f"conv(hex(substring(sig, tree * {4 * DEPTH} + {{0}}, 4)), 16, 10)"
    level = classes.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    level = level.select(F.expr(f"xxhash64(tree, {word.format(1)})").alias("node"), "rep", "tree")
    done = None
    for d in range(DEPTH):
        sizes = level.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("first"), F.bit_xor(F.xxhash64("rep", F.lit("held"))).alias("held")).filter("n > 1")
        sizes = scratch.table(sizes, f"sizes{d}")
        level = scratch.table(sieve(level, sizes.select("node"), "node").join(sizes, "node"), f"level{d}")
        small = level.filter(f"n <= {SMALL}").select(F.xxhash64("n", "first", "held").alias("node"), "rep")
        done = small if done is None else done.unionByName(small)
        large = level.filter(f"n > {SMALL}").select("node", "rep", "tree")
        if d + 1 == DEPTH or large.isEmpty():
            break
        level = large.join(classes.select("rep", "sig"), "rep").select(F.expr(f"xxhash64(node, {word.format(4 * (d + 1) + 1)})").alias("node"), "rep", "tree")
    return done, large.select("node", "rep")


def candidate_edges(classes: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(a, b): classes that signatures say may be linked; a spanning set of every node's such pairs."""
    small, large = tree_nodes(classes, scratch)
    # a node that stayed large: blocks of it, dealt anew in every node, and the node's first class in each
    sizes = large.groupBy("node").agg(F.min("rep").alias("first"), F.count("*").alias("n"))
    blocks = large.join(sizes, "node").withColumn("block", F.expr(f"pmod(xxhash64(node, rep, 'block'), cast(ceil(n / {SMALL}) as int))"))
    starts = sizes.withColumn("block", F.explode(F.expr(f"sequence(0L, ceil(n / {SMALL}) - 1)"))).selectExpr("xxhash64(node, block) node", "first rep")
    groups = small.unionByName(blocks.selectExpr("xxhash64(node, cast(block as bigint)) node", "rep")).unionByName(starts)
    rows = groups.distinct().join(classes.select("rep", "sig"), "rep")

    def compared(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep")
        reps = part["rep"].to_numpy()
        sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(len(part), _N)
        parts = Parts(len(reps))
        for i in range(len(reps) - 1):
            for j in np.flatnonzero((sig[i + 1 :] == sig[i]).mean(1) >= least):
                parts.join(i, i + 1 + int(j))
        roots = np.array([parts.root(i) for i in range(len(reps))])
        other = roots != np.arange(len(reps))
        return pd.DataFrame({"a": reps[roots[other]], "b": reps[other]})

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Nodes as runs of sorted rows; one node, of bounded size, is held at a time."""
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            last = held["node"].iloc[-1] if len(held) else None
            whole, held = held[held["node"] != last], held[held["node"] == last]
            found = [compared(g) for _, g in whole.groupby("node", sort=False)]
            if found:
                yield pd.concat(found)
        if held is not None and len(held):
            yield compared(held)

    return rows.repartition("node").sortWithinPartitions("node").mapInPandas(stream, "a long, b long").distinct()


def is_stars(e: DataFrame) -> bool:
    """Whether every node of the edges (u, v) is either a centre v or has one edge to a centre."""
    ends = e.selectExpr("u x", "1 up", "0 top").unionByName(e.selectExpr("v x", "0 up", "1 top"))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("top").alias("top")).filter("up > 1 or (up > 0 and top > 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """(id, root): for all ids of the edges the smallest id reachable, by large-star and small-star rounds.

    Each round joins every node's larger neighbours to its smallest one, then its smaller ones; a hot node costs
    its edges only, which the rounds shorten to stars.  It ends once the edges are stars.
    """
    e = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    for k in range(rounds):
        if is_stars(e):
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        new = small.selectExpr("u", "m v").unionByName(small.filter("v <> m").selectExpr("v u", "m v")).filter("u <> v").distinct()
        e = scratch.table(new, f"cc{k}")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def confirm(groups: DataFrame, docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(a, b): a spanning set of the true links among the classes of each candidate group (id, root, n).

    Texts are read again for members of groups only: the scan is sieved by their ids before its exchange.
    """
    per = groups.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    blocks = groups.join(per, "root").withColumn("blocks", F.expr(f"cast(greatest(ceil(size / {BLOCK}), ceil(total / {BLOCK_SHINGLES})) as int)")).withColumn("block", F.expr("pmod(xxhash64(id, 'b'), blocks)"))
    texts = docs.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text")
    texts = sieve(texts, groups.select("id"), "id").join(blocks.select("id", "root", "block", "blocks"), "id")
    texts = scratch.table(texts, "texts")

    def within(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["id", "text"]).sort_values("id")
        ids, sets = part["id"].to_numpy(), [shingles(t, n) for t in part["text"]]
        sizes = np.array([len(s) for s in sets])
        tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        mark, parts = np.zeros(len(tokens), np.int64), Parts(len(ids))
        for i in np.flatnonzero(ids[1:] == ids[:-1]):  # texts of one id share its component
            parts.join(int(i), int(i) + 1)
        for i in range(len(ids) - 1):
            own = inverse[starts[i] : starts[i] + sizes[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[inverse[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
            mark[own] = 0
            for j in np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[i + 1 :] - both)):
                parts.join(i, i + 1 + int(j))
        roots = np.array([parts.root(i) for i in range(len(ids))])
        return pd.DataFrame({"root": part["root"].to_numpy(), "a": ids[roots], "b": ids}).drop_duplicates()

    inner = scratch.table(texts.groupBy("root", "block").applyInPandas(within, "root long, a long, b long"), "inner")
    # groups of several blocks: one member of each part but a group's largest meets all blocks of the group, then all
    # members that are still outside the largest part do; after that only pairs within one part have not met
    links = inner.filter("a <> b").select("a", "b")
    many = texts.filter("blocks > 1")
    if many.isEmpty():
        return links
    split = scratch.table(inner.join(many.select("root").distinct(), "root", "left_semi"), "split")
    places = many.selectExpr("root q_root", "block q_block").distinct()
    own, asked = split.filter("a <> b").select("a", "b"), None
    for k in range(2):
        parts = components(own, scratch)
        state = scratch.table(split.select("root", F.col("b").alias("id")).join(parts.withColumnRenamed("root", "part"), "id", "left").select("root", "id", F.coalesce("part", "id").alias("part")), f"state{k}")
        sizes = state.groupBy("root", "part").agg(F.count("*").alias("size"))
        best = sizes.groupBy("root").agg(F.max(F.struct("size", F.negate("part").alias("k"))).alias("m"), F.count("*").alias("parts")).filter("parts > 1").selectExpr("root", "-m.k largest")
        outside = state.join(best, "root").filter("part <> largest").select("root", "id", "part")
        ask = outside.filter("part = id") if asked is None else outside.join(asked.select("id"), "id", "left_anti")
        turns = ask.groupBy("root").agg(F.expr(f"cast(ceil(count(*) / {ASKED}) as int)").alias("turns"))
        ask = scratch.table(ask.join(turns, "root").withColumn("turn", F.expr("pmod(xxhash64(id, 't'), turns)")), f"ask{k}")
        if ask.isEmpty():
            return links
        fans = ask.join(many.select("id", "text"), "id").selectExpr("root q_root", "turn q_turn", "id q_id", "part q_part", "text q_text").join(places, "q_root")
        members = many.select("root", "block", "id", "text").join(state.select("id", "part"), "id")
        members = members.join(ask.select("root", "turn").distinct(), "root")

        def across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple[int, int]] = []
            if len(left) and len(right):
                ids, part = right["id"].to_numpy(), right["part"].to_numpy()
                sets = [shingles(t, n) for t in right["text"]]
                sizes = np.array([len(s) for s in sets])
                tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
                starts, mark = np.cumsum(sizes) - sizes, np.zeros(len(tokens), np.int64)
                for q, own_part, text in zip(left["q_id"], left["q_part"], left["q_text"], strict=True):
                    s = shingles(text, n)
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    at = at[tokens[at] == s]
                    mark[at] = 1
                    both = np.add.reduceat(mark[inverse], starts)
                    mark[at] = 0
                    hit = (100 * both >= percent * (len(s) + sizes - both)) & (part != own_part)
                    for p in np.unique(part[hit]):  # one link to each part is enough
                        i = int(ids[hit & (part == p)].min())
                        out.append((min(i, q), max(i, q)))
            return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

        found = scratch.table(fans.groupBy("q_root", "q_block", "q_turn").cogroup(members.groupBy("root", "block", "turn")).applyInPandas(across, "a long, b long").distinct(), f"found{k}")
        links, own, asked = links.unionByName(found), own.unionByName(found), ask
        if outside.filter("part <> id").isEmpty():
            break
    return links


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    A set holds a text's distinct shingles of ``n`` words (split at ASCII white space, A-Z in lower case); with fewer
    words, the whole sequence is one shingle; null, empty and blank texts have an empty set and are linked with nothing.
    Two documents are linked if 100 times the intersection is at least ``percent`` times the union; a component has the
    smallest id that links reach.  Shingles are compared by 64-bit digests.  Rows with a null id are each their own
    component, with a null component id, and kept; repeated rows of an id are returned each.  Other columns are not read.
    """
    spark = docs.sparkSession
    sets, scratch = materialize(sets_table(docs, n, id_col, text_col), "near-sets"), Scratch(spark, "near")
    whole = sets.filter("doc_id is not null and key is not null")
    # the signature is a function of the set, so any one of a class is that of its first document
    classes = whole.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = scratch.table(classes, "classes")
    edges = candidate_edges(classes.select("rep", "sig"), percent / 100 - 0.25, scratch)
    groups = components(edges, scratch)
    sizes = classes.select(F.col("rep").alias("id"), "n")
    groups = groups.join(sieve(sizes, groups, "id").groupBy("id").agg(F.max("n").alias("n")), "id")
    roots = components(confirm(scratch.table(groups, "groups"), docs, n, percent, id_col, text_col, scratch), scratch)
    named = classes.select("key", "rep", "copies").join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("root", "rep"))
    # only classes of several documents, or linked ones, differ from their own id: few rows meet in the join by key
    moved = materialize(named.filter("copies > 1 or component_id <> rep").select("key", "component_id"), "near-named")
    scratch.drop()
    out = sets.select("doc_id", "n_shingles", "key").join(moved, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by sets of three words; null, blank and very long texts, and repeated rows, as in ``near_duplicates``."""
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"), 3, 85)


def oracle(n: int = 3, percent: int = 85) -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {n} THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + {n - 1}], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
cls AS (SELECT h, min(doc_id) AS rep FROM sets GROUP BY h),
r AS (SELECT s.* FROM s JOIN cls ON s.doc_id = cls.rep),
rare AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS k FROM (SELECT *, count(*) OVER (PARTITION BY g) AS df FROM r)),
pre AS (SELECT rare.doc_id, g FROM rare JOIN n USING (doc_id) WHERE k <= n - ceil({percent} * n / 100.0) + 1),
cand AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id),
inter AS (SELECT x, y, count(*) AS i FROM cand JOIN r a ON a.doc_id = x JOIN r b ON b.doc_id = y AND b.g = a.g GROUP BY x, y),
links AS (SELECT x, y FROM inter JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= {percent} * (a.n + b.n - i)),
e AS (SELECT x AS a, y AS b FROM links UNION SELECT y, x FROM links UNION SELECT rep, rep FROM cls),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
root AS (SELECT a AS rep, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN cls USING (h) LEFT JOIN root USING (rep)
"""


ORACLE = oracle()


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with the columns of ``docs``.

    Null, empty and blank texts are linked with nothing and stay, as do rows with a null id and repeated rows of a kept id;
    rows of an id go together if any of them is not kept.  An empty table stays empty.
    """
    gone = near_duplicates(docs.select(id_col, text_col), n, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
