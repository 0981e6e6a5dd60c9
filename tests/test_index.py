"""The stored index: the same results as a scan of all memories, from a part of the postings."""

import random

import pytest

from recallforge.functions import entities
from recallforge.functions.text import stemmed
from recallforge.operators import search
from recallforge.sources import index
from recallforge.sources.shared import Scratch

MEMORY = "id long, namespace string, source_event_id string, content string, importance double, metadata map<string,string>"
BM25 = search.Search(limit=4, weights=search.BM25_ONLY, per_source=None, matches_only=True)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(index, "SEGMENT", 9)
    monkeypatch.setattr(index, "SEGMENT_BYTES", 2000)
    monkeypatch.setattr(index, "WHOLE", 5)
    monkeypatch.setattr(index, "RANGES", 16)
    monkeypatch.setattr(index, "SEED", 3)


def memories(n, rnd, spaces="ab"):
    words = ["walk", "walking", "walker", "river", "rivers", "Ann", "Bob", "tea", "teapot", "house", "É", "it's", "zebra"] + [f"rare{i}" for i in range(40)]
    kinds = ["verbatim_turn", "observation", "z"]
    return [
        (i, rnd.choice(spaces), rnd.choice([None, "s_1", "s_2", "t_x", "c_3_u"]), " ".join(rnd.choice(words[: rnd.choice([13, 53])]) for _ in range(rnd.randint(0, 30))) or None, rnd.random(), {"speaker": rnd.choice(["", "Ann"]), "memory_kind": rnd.choice(kinds)})
        for i in range(n)
    ]


def rows_of(hits):
    return {tuple(r) for r in hits.collect()}


def test_indexed_search_equals_the_scan(spark, small):
    rnd = random.Random(4)
    rows = memories(400, rnd)
    queries = [(f"q{i}", rnd.choice("abc"), " ".join(rnd.choice(["walks", "Ann", "Bob's", "tea", "rare3", "rare7", "rare9", "é", "zz", "house"]) for _ in range(rnd.randint(0, 7)))) for i in range(25)]
    held = spark.createDataFrame(rows, MEMORY).repartition(3)
    asked = spark.createDataFrame(queries, "query_id string, namespace string, text string")
    with Scratch(spark) as scratch:
        whole = index.TextIndex.build(held, scratch.path("index"))
        columns = ("query_id", "id", "source", "score", "rank")
        for plan in (BM25, search.Search(limit=5), search.Search(limit=40), search.Search(limit=3, weights={"bm25": 1.0}, matches_only=True, per_source=1)):
            prepare = entities.enrich
            got = rows_of(search.search(held, asked, plan, whole, prepare).select(*columns))
            assert got == rows_of(search.search(prepare(held), asked, plan).select(*columns)) and got
        assert search.search(held, asked.limit(0), BM25, whole).count() == 0


def test_segments_are_appended_and_texts_may_be_empty(spark, small):
    rnd = random.Random(5)
    rows = memories(60, rnd, ["default"])
    asked = spark.createDataFrame([(1, "walk rare1 tea"), (2, "nothing of it"), (3, "")], "query_id long, text string")
    with Scratch(spark) as scratch:
        path = scratch.path("index")
        index.TextIndex.build(spark.createDataFrame(rows[:25], MEMORY), path)
        whole = index.TextIndex(spark, path)
        whole.append(spark.createDataFrame(rows[25:], MEMORY))
        held = spark.createDataFrame(rows, MEMORY)
        assert rows_of(search.search(held, asked, BM25, whole).select("query_id", "id", "score")) == rows_of(search.search(held, asked, BM25).select("query_id", "id", "score"))
        none = index.TextIndex.build(held.limit(0), scratch.path("none"))
        assert search.search(held.limit(0), asked, BM25, none).count() == 0
        with pytest.raises(Exception, match="(?i)exist"):
            index.TextIndex.build(held, path)


def test_a_search_opens_a_part_of_the_postings(spark, monkeypatch):
    monkeypatch.setattr(index, "SEGMENT", 100)
    rnd = random.Random(6)
    rows = [(i, " ".join([f"common{rnd.randrange(3)}" for _ in range(20)] + ([f"rare{i % 2}"] * 3 if i % 401 == 0 else []))) for i in range(2000)]
    held = spark.createDataFrame(rows, "id long, content string").repartition(4)
    terms = sorted(set(stemmed("common0 common1 common2 rare0 rare1")))
    with Scratch(spark) as scratch:
        whole = index.TextIndex.build(held, scratch.path("index"))
        found = whole.search(index.Asked(["default"], [terms]), scratch)
        every = sorted((-r.value, r.id) for r in found.above([0.0]).collect())
        assert len(every) == 2000 and {i % 401 for _, i in every[:5]} == {0}
        assert sorted((-r.value, r.id) for r in found.best(5, scratch).filter("q >= 0").collect())[:5] == every[:5]
        assert sorted((-r.value, r.id) for r in found.above([-every[4][0]]).collect()) == every[:5]
        read = found._evaluated("true", None, [-every[4][0]], 6).filter("q < 0").selectExpr("sum(held) held", "sum(opened) opened").first()
        assert read.held > 5500 and 0 < read.opened < 0.3 * read.held  # common terms are in nearly all memories, rare ones in a few segments


def test_rows_of_other_terms_and_namespaces_are_not_read(spark, small):
    held = spark.createDataFrame(memories(200, random.Random(7)), MEMORY)
    with Scratch(spark) as scratch:
        whole = index.TextIndex.build(held, scratch.path("index"))
        asked = index.Asked(["a"], [["tea"]])
        rows = whole._rows("postings", asked)
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
        assert "kind#" in plan.split("PartitionFilters")[1] and "LessThanOrEqual(low," in plan and "EqualTo(namespace,a)" in plan
        assert 0 < rows.count() < spark.read.parquet(whole.path).filter("kind = 'postings'").count() / 4


def test_windows_of_tokens_in_memories(spark):
    rnd = random.Random(9)
    words = ["a", "b", "É", "it's", "running", "runs"]
    texts = [" ".join(rnd.choice(words) + rnd.choice(["", ".", "\n"]) for _ in range(rnd.randint(0, 30))) for _ in range(80)] + [None, ""]
    asked = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 8)))) for k in range(20)]
    got = rows_of(search.contains_windows(spark.createDataFrame([*enumerate(texts)], "id long, content string"), spark.createDataFrame(asked, "query_id long, text string"), 4))
    want = set()
    for k, q in asked:
        bag = stemmed(q)
        n = min(4, len(bag))
        grams = {tuple(bag[i : i + n]) for i in range(len(bag) - n + 1)} if n else set()
        for i, t in enumerate(texts):
            b = stemmed(t)
            if any(tuple(b[j : j + n]) in grams for j in range(len(b) - n + 1)):
                want.add((k, i))
    assert got == want and len(want) > 50


def test_a_segment_of_long_texts_is_bounded_by_bytes(spark, tmp_path):
    """A segment ends with the text that fills it (before, up to 511 more texts of any length came into it)."""
    most = index.SEGMENT_BYTES
    rows = spark.range(40, numPartitions=1).selectExpr("id", "'n' namespace", f"repeat('long text ', {most // 40}) content")
    built = index.TextIndex.build(rows, str(tmp_path / "long"))
    sizes = [r.n for r in spark.read.parquet(built.path).filter("kind = 'memories'").select("n").collect()]
    assert sum(sizes) == 40 and max(sizes) <= 5
