"""The library's own operators on small hand-worked inputs, and every query against its SQL."""

import importlib.util

import duckdb
import pytest

from recallforge.functions import normal as N
from recallforge.functions import stem
from recallforge.functions import text as T
from recallforge.operators import evaluate, ingest, retrieve, search
from recallforge.plans import queries as core
from recallforge.plans import registry
from recallforge.sources import log

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_tokens(spark):
    df = spark.createDataFrame([("Ann's dogs, don't RUN'",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.tokens("t")).collect()] == [["ann", "dogs", "don't", "run"], [], []]


def test_windows_cover_every_turn(spark):
    for n in range(0, 13):
        df = spark.createDataFrame([("c", i, "u", f"t{i}") for i in range(n)], "namespace string, seq long, actor string, text string")
        got = sorted((r.window, r.full, r.n_turns) for r in ingest.windows(df, 5).collect())
        full, start, want = 0, 0, []
        while start + 5 <= n:
            want.append((full, True, 5))
            full, start = full + 1, start + 3
        if start < n:
            want.append((full, False, n - start))
        assert got == want, n


def test_latest_record_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y")], "id string, seq long, v string")
    assert sorted(map(tuple, log.latest(df, "id", "seq").collect())) == [("a", 3, "z"), ("b", 2, "y")]


def test_metrics(spark):
    df = spark.createDataFrame([(1, [5, 7], [9, 5, 7]), (2, [], [1])], "query_id int, evidence array<int>, retrieved array<int>")
    a, b = evaluate.metrics(df).orderBy("query_id").collect()
    assert (a.recall_1, a.recall_3, a.mrr) == (0.0, 1.0, 0.5) and b.mrr == b.recall_10 == b.ndcg_5 == 0.0


def brute_fold(rows, least=0.72):
    """Every row against all memories before it, in order."""
    out = []
    for r in sorted(rows, key=lambda r: r["seq"]):
        mine = set(T.stemmed(r["content"]))
        for m in out:
            theirs = set(T.stemmed(m["content"]))
            if ingest.ascii_lower(m["content"]) == ingest.ascii_lower(r["content"]) or (mine and theirs and len(mine & theirs) / len(mine | theirs) >= least):
                m["content"] = T.merged(m["content"], r["content"])
                m["merged"] += 1
                break
        else:
            out.append({**r, "merged": 1})
    return sorted((m["content"], m["seq"], m["merged"]) for m in out)


def test_fold_equals_brute_force(spark):
    import random

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(220):
        content = " ".join(rnd.sample(words, rnd.randint(1, 9))) if not rows or rnd.random() < 0.5 else rnd.choice(rows)["content"]
        if rnd.random() < 0.3:
            content = content.upper() if rnd.random() < 0.4 else content + " " + rnd.choice(words)
        rows.append({"namespace": "n", "memory_type": "semantic", "seq": i, "content": content, "importance": rnd.random(), "confidence": 0.5})
    got = ingest.fold(spark.createDataFrame(rows)).collect()
    assert sorted((r.content, r.seq, r.merged) for r in got) == brute_fold(rows) and len(got) < 200


def test_fold_keeps_the_first_rows_place_and_takes_new_metadata(spark):
    rows = [("a", "n", "semantic", "I like tea", "e1", 0.5, 0.5, {"k": "1", "x": "y"}, 1), ("b", "n", "semantic", "i LIKE tea", "e2", 0.9, 0.4, {"k": "2"}, 2), ("c", "n", "semantic", "I like tea", "e3", 0.1, 0.1, {"side_channel": "x"}, 3), ("d", "n", "episodic", "I like tea", "e4", 0.2, 0.2, {}, 4)]
    got = {r.id: r for r in ingest.fold(spark.createDataFrame(rows, "id string, namespace string, memory_type string, content string, source_event_id string, importance double, confidence double, metadata map<string,string>, seq long")).collect()}
    assert set(got) == {"a", "c", "d"} and (got["a"].source_event_id, got["a"].importance, got["a"].confidence, got["a"].merged) == ("e1", 0.9, 0.5, 2)
    assert got["a"].metadata == {"k": "2", "x": "y"} and got["c"].merged == 1


def test_candidates_and_summaries(spark):
    rows = [("n", "e1", "user", "I like green tea a lot. i like green tea a lot! Ok. We met by the old lake"), ("n", "e2", "bot", "a b. c d. e f. g h. i j"), ("n", "e3", "bot", "a b. c d"), ("n", "e4", "bot", None)]
    got = [tuple(r) for r in ingest.candidates(spark.createDataFrame(rows, "namespace string, event_id string, actor string, text string")).orderBy("event_id", "pos").collect()]
    assert got == [
        ("n", "e1", 0, "I like green tea a lot", "semantic", 0.85, 0.82), ("n", "e1", 3, "We met by the old lake", "episodic", 0.45, 0.58),
        ("n", "e2", 0, "bot said: a b. c d. e f. g h. i j", "episodic", 0.35, 0.55),
    ]


def test_source_cap(spark):
    df = spark.createDataFrame([(1, i, "s" if i < 4 else None, float(i)) for i in range(6)], "query_id int, id int, source string, score double")
    assert sorted(r.id for r in retrieve.cap_sources(df).collect()) == [2, 3, 4, 5]


def test_context_has_whole_memories(spark):
    """Every memory of a context is whole and has its score; nearly all are longer than forty characters."""
    texts = [r.content for r in registry.memories(spark, DIR).collect()]
    contexts = [r.context for r in core.QUERIES["build_context"](spark, DIR).collect()]
    assert contexts and all(c.startswith("# Agent Memory\n- [episodic score=") for c in contexts)
    assert all(any(c.endswith("] " + t + "\n") for t in texts if t is not None) for c in contexts) and any(len(c) > 1000 for c in contexts)
    hits = spark.createDataFrame([(1, 1, 0.5, "semantic", 0.75, "a")], "query_id long, rank int, score double, memory_type string, confidence double, content string")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert {r.query_id: r.context for r in retrieve.build_context(hits, asked).collect()} == {1: "# Agent Memory\n- [semantic score=0.500 confidence=0.75] a\n", 2: ""}


def test_rules_and_judge_read_whole_tables(spark):
    turns = registry.table(spark, DIR, "conversations").count()
    assert core.QUERIES["classify_rules"](spark, DIR).select("conv_id", "turn").distinct().count() > turns // 2
    assert core.QUERIES["judge_exact"](spark, DIR).count() > turns // 2


def test_evidence_of_whole_items(spark):
    """A later passage of an item, and an item of under eight tokens, are evidence too."""
    docs = spark.createDataFrame([(1, "x c d e f g h i j y"), (2, "say red fox now"), (3, "a b c d"), (4, "red"), (5, None)], "id long, content string")
    asked = spark.createDataFrame([(7, "a b c d e f g h i j"), (8, "red fox"), (9, "")], "query_id long, text string")
    assert sorted(map(tuple, search.contains_windows(docs, asked).collect())) == [(7, 1), (8, 2)]


def test_rules_on_sentences(spark):
    from pyspark.sql import functions as F

    said = {"I prefer green tea": "semantic", "Remember that the door is red": "semantic", "When you deploy, use the script": "procedural", "Next time we test first": "reflection", "We went to the lake": "episodic", "hello": None, "thank you": None}
    df = spark.createDataFrame([(x,) for x in said], "x string").withColumn("c", T.classify(F.lower("x")))
    got = {r.x: r.memory_type if r.keep else None for r in df.select("x", "c.memory_type", T.should_keep(F.lower("x"), F.col("c.memory_type")).alias("keep")).collect()}
    assert got == said


# Pairs of the published sample vocabulary and of the algorithm's description.
STEMS = (
    "consigned consign consistency consist consolatory consolatori consolingly consol knightly knight knocked knock kneeling kneel generously generous "
    "communication communic skies sky dying die happy happi hopping hop hoping hope relational relat ties tie cries cri gas gas gaps gap kiwis kiwi "
    "luxuriated luxuri news news proceed proceed national nation cement cement say say by by enjoy enjoy bed bed shed shed hopefulness hope"
).split()


def test_stems_of_the_published_sample():
    assert [stem.stem(w) for w in STEMS[::2]] == STEMS[1::2]


def test_lenient_forms_and_turn_index(spark):
    df = spark.createDataFrame([("The Twenty-first of AN Éa, three cats!", "conv_1_turn_+5_x"), ("", "none"), (None, None)], "t string, s string")
    from pyspark.sql import functions as F

    got = [tuple(r) for r in df.select(N.lenient(F.col("t")), N.turn_index(F.col("s"))).collect()]
    assert got == [("20 fir of 3 cats", 5), ("", None), ("", None)]


def canonical(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = core.QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    want = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({core.ORACLES[name]})").fetchall()
    assert canonical(map(tuple, got.select(*[f"`{c}`" for c in cols]).collect())) == canonical(want)


def test_entry_imports():
    assert importlib.util.find_spec("__spark_entry__") is not None
    import __spark_entry__

    assert set(core.QUERIES) <= set(__spark_entry__.queries())
