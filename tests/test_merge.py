"""Merges on write by components, against one ordered replay."""

import random

import numpy as np
import pytest
from test_core import brute_fold

from recallforge.functions.text import stemmed
from recallforge.operators import graph, ingest, merge
from recallforge.sources.shared import Scratch


def test_components_of_edges(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(90)] + [(i, i + 1) for i in range(300, 340)] + [(None, 5), (7, 7)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        return x if up[x] == x else root(up[x])

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    with Scratch(spark) as scratch:
        got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
        assert got == {x: root(x) for x in up}
        assert graph.components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


@pytest.mark.parametrize("block", [3, 1024])
def test_pairs_that_overlap_are_all_found(spark, monkeypatch, block):
    monkeypatch.setattr(merge, "BLOCK", block)
    rnd = random.Random(block)
    sets = [(i, sorted(rnd.sample(range(25), rnd.randint(1, 9)))) for i in range(150)]
    sets += [(200 + i, [99, i]) for i in range(12)] + [(300, []), (301, [7])]  # many sets of a common token
    df = spark.createDataFrame(sets, "node long, tokens array<long>")
    want = {(a, b) for a, x in sets for b, y in sets if a != b and x and y and len({*x} & {*y}) >= 0.72 * len({*x} | {*y})}
    assert {tuple(r) for r in merge.overlapping(df, df, 0.72, same=True).collect()} == want and want
    some = df.filter("node % 5 = 0")
    assert {tuple(r) for r in merge.overlapping(some, df, 0.72).collect()} == {(a, b) for a, b in want if a % 5 == 0}


def rows_of(contents, space="n", kind="semantic"):
    return [{"namespace": space, "memory_type": kind, "seq": i, "content": c, "importance": 0.5, "confidence": 0.5} for i, c in enumerate(contents)]


def test_what_merging_makes_links_components(spark):
    """The merged memory of the first two rows matches the third one, which neither of them does."""
    a, b, c = "w1 w2 w3 w4 w5 w6 w7", "w2 w3 w4 w5 w6 w7 w8", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"
    sets = [set(stemmed(x)) for x in (a, b, c)]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.72 and all(len(s & sets[2]) / len(s | sets[2]) < 0.72 for s in sets[:2])
    rows = rows_of([a, b, c, "other words", "", "", "!!", "?", None])
    rows[-1]["content"] = "last one"
    got = ingest.fold(spark.createDataFrame(rows)).collect()
    assert sorted((r.content, r.seq, r.merged) for r in got) == brute_fold(rows) and max(r.merged for r in got) == 3


def test_one_namespace_is_replayed_in_many_components(spark, monkeypatch):
    monkeypatch.setattr(merge, "BLOCK", 5)
    rnd = random.Random(17)
    contents = []
    for i in range(500):
        topic = [f"t{i % 40}x{j}" for j in range(8)]
        words = rnd.sample(topic, rnd.randint(4, 8)) + rnd.choice([[], ["so"], ["so", "very"]])
        contents.append(rnd.choice([" ".join(words), " ".join(words).upper(), rnd.choice(contents or ["x y"])]))
    rows = rows_of(contents)
    with Scratch(spark) as scratch:
        held = spark.createDataFrame(rows).selectExpr("cast(seq as string) id", "namespace", "memory_type", "content", "cast(null as string) source_event_id", "importance", "confidence", "map() metadata", "seq")
        held = held.selectExpr("id", "namespace", "memory_type", "content", "source_event_id", "importance", "confidence", "cast(metadata as map<string,string>) metadata", "seq")
        out = merge.merge_components(held, ingest.SAME, ingest.Pool, ingest._FOLDED, scratch).collect()
    memories = [r for r in out if r.state is None]
    assert len({r.root for r in memories}) > 30
    assert sorted((r.content, r.seq, r.merged) for r in memories) == brute_fold(rows)
    assert len(memories) < 400 and any(r.state for r in out)


def test_an_empty_table_and_namespaces_apart(spark):
    assert ingest.fold(spark.createDataFrame(rows_of(["a b c"])).limit(0)).count() == 0
    rows = rows_of(["a b c", "a b c"]) + rows_of(["a b c"], "m") + rows_of(["a b c"], kind="episodic")
    got = sorted((r.namespace, r.memory_type, r.merged) for r in ingest.fold(spark.createDataFrame(rows)).collect())
    assert got == [("m", "semantic", 1), ("n", "episodic", 1), ("n", "semantic", 2)]


def test_large_and_small_places_give_the_same_matches(monkeypatch):
    rnd = random.Random(4)
    sets = [sorted(rnd.sample(range(12), rnd.randint(1, 8))) for _ in range(120)]
    place = np.sort(np.array([rnd.randrange(5) for _ in sets]))
    side = np.concatenate([np.sort(np.array([rnd.randrange(2) for _ in range(n)])) for n in np.bincount(place)])
    node = np.array(rnd.sample(range(1000), len(sets)))
    offsets = np.cumsum([0, *map(len, sets)])
    for same in (True, False):
        found = []
        for short in (64, 0):
            monkeypatch.setattr(merge, "SHORT", short)
            i, j = merge._matches(place, side, node, offsets, np.concatenate(sets), 0.6, same)
            found.append({*zip(i.tolist(), j.tolist(), strict=True)})
        n = range(len(sets))
        want = {(i, j) for i in n for j in n if place[i] == place[j] and side[i] < side[j] and len({*sets[i]} & {*sets[j]}) >= 0.6 * len({*sets[i]} | {*sets[j]}) and (node[i] < node[j] or not same)}
        assert found == [want, want] and want


def test_only_crowded_namespaces_are_cut_into_components(spark, monkeypatch):
    rnd = random.Random(23)
    rows = []
    for space, n in (("a", 12), ("b", 90), (None, 9)):
        rows += rows_of([" ".join(rnd.sample([f"w{j}" for j in range(7)], rnd.randint(3, 7))) for _ in range(n)], space)
    given = spark.createDataFrame(rows, "namespace string, memory_type string, seq long, content string, importance double, confidence double")
    cut, plain = [], ingest.merge_components
    monkeypatch.setattr(ingest, "merge_components", lambda rows, *more: cut.extend(r.namespace for r in rows.select("namespace").distinct().collect()) or plain(rows, *more))
    for most, crowded in ((4096, []), (20, ["b"])):
        cut.clear()
        monkeypatch.setattr(ingest, "APART", most)
        got = ingest.fold(given).collect()
        assert cut == crowded
        for space in ("a", "b", None):
            assert sorted((r.content, r.seq, r.merged) for r in got if r.namespace == space) == brute_fold([r for r in rows if r["namespace"] == space])


@pytest.mark.parametrize("paired", [1, 6, 64])
def test_sets_that_overlap_share_a_key_and_few_others_do(monkeypatch, paired):
    monkeypatch.setattr(merge, "PAIRED", paired)
    rnd = random.Random(paired)
    for least in (0.3, 0.72, 1.0):
        sets = [sorted(rnd.sample(range(14), rnd.randint(0, 12))) for _ in range(200)]
        offsets = np.cumsum([0, *map(len, sets)])
        row, key = merge._keys(offsets, np.concatenate(sets).astype(np.int64), (np.array([2, 5, 9]), np.array([80, 70, 90])), least)
        keys = [set() for _ in sets]
        for i, k in zip(row.tolist(), key.tolist(), strict=True):
            keys[i].add(k)
        want = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if x and y and len({*x} & {*y}) >= least * len({*x} | {*y})]
        assert want and all(keys[i] & keys[j] for i, j in want)
    if paired == 64:
        # of sets of few words, as many more as there are, far fewer meet than share one of their rarest tokens
        sets = np.sort(np.array([rnd.sample(range(300), 10) for _ in range(3000)]))
        key = merge._keys(np.arange(3001) * 10, sets.ravel(), (np.empty(0, np.int64), np.empty(0, np.int64)), 0.72)[1]
        met = np.unique(key, return_counts=True)[1]
        single = np.bincount(sets[:, :3].ravel())
        assert 20 * (met * (met - 1)).sum() < (single * (single - 1)).sum()


def test_only_components_that_meet_are_replayed_again_and_rows_are_made_twice(spark, monkeypatch):
    a, b, c = "w1 w2 w3 w4 w5 w6 w7", "w2 w3 w4 w5 w6 w7 w8", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"
    rows = rows_of([a, b, *[f"x{i // 2} y{i // 2} z{i // 2}" for i in range(40)], c, *[f"alone{i}" for i in range(9)]])
    made, counts, plain = spark.sparkContext.accumulator(0), [], merge.replayed

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(ingest, "APART", 20)
    monkeypatch.setattr(merge, "replayed", lambda rows, *more: counts.append(rows.count()) or plain(rows, *more))
    df = spark.createDataFrame(rows)
    got = ingest.fold(df.mapInArrow(counted, df.schema)).collect()
    assert sorted((r.content, r.seq, r.merged) for r in got) == brute_fold(rows)
    assert counts == [42, 3]
    # once for the sizes of namespaces, once for all that follows
    assert made.value == 2 * len(rows)
