"""Answers, evidence, rerankers and judges on hand-worked examples."""

import json

import pytest
from pyspark.sql import functions as F

from recallforge.functions import dates
from recallforge.operators import answer, evaluate, evidence, rerank
from recallforge.providers import FixtureProvider, LlmError, request_hash

CASES = [  # question, evidence, answer
    ("What speed does my new line have?", ["The line is fine.", "My new line runs at 300 Mbps now."], "300 Mbps"),
    ("Who sent me the lamp as a gift?", ["The lamp was a gift from my brother, I love it."], "my brother"),
    ("When did Ann visit the museum?", ["[verbatim_turn time=2:10 pm on 4 March, 2021] Ann: I was at the museum yesterday."], "2021"),
    ("When did Ann visit the museum?", ["On 3 June, 2020, I saw the museum last year."], "2019"),
    ("When did Ann see her friends?", ["[verbatim_turn time=9:00 am on 12 April, 2022] Ann: we all met last week!"], "week before 12 April 2022"),
    ("When was the dinner?", ["The dinner took place on Valentine's Day."], "Valentine's Day"),
    ("Where did Ann move from?", ["The vase is from my aunt in my old home, Norway."], "Norway"),
    ("Where do I swim?", ["I relax near Lake Baths before work."], "Lake Baths"),
    ("Where has Ann hiked?", ["Ann hiked on the ridge.", "Ann hiked in the valley."], "ridge, valley"),
    ("Where did Rex hide his bone?", ["Ann: Rex put the bone under my pillow once."], "in Ann's pillow"),
    ("What is Ann's relationship status?", ["Being a single parent is hard."], "Single"),
    ("What fields would Ann study in her education?", ["Ann is considering a teaching license after studying history."], "History, teaching license"),
    ("What activities does Ann do?", ["Ann signed up for a judo class.", "Ann went hiking.", "Ann painted a barn."], "judo, hiking, painting"),
    ("What do the kids like?", ["The kids were stoked for the mammoth exhibit.", "The kids love rain."], "mammoths, rain"),
    ("What did Ann explore?", ["Ann: Exploring old caves - a dream of mine."], "old caves"),
    ("What did Ann notice after the walk?", ["Ann took a walk.", "Ann began to notice that rest is needed."], "rest is needed"),
    ("What play did I see?", ["It was a production of The Long Night."], "The Long Night"),
    ("What are the pets' names?", ["Ann: I have two cats, Milo and Nora, and a dog named Otis."], "Milo, Nora, Otis"),
    ("What does the ring symbolize?", ["Ann: The ring symbolizes hope, trust, and time."], "hope, trust, and time"),
    ("How does Ann calm down?", ["How is the weather there?", "Ann calms down by reading every night for an hour, mostly."], "by reading every night for an hour"),
    ("What has running been great for, Ann?", ["Ann: Running has been great for my sleep."], "my sleep"),
    ("How long has Ann known her friends?", ["I have known these friends for 6 years, since school."], "6 years"),
    ("Would Ann enjoy a cruise?", ["Ann: The sea scares me."], "None"),
    ("Did Ann bake the green cake?", ["Bob: I baked that green cake at home.", "Bob said the green cake was his."], "No"),
    ("What kind of drum does Cyd play at night?", ["Cyd: I was out a lot.", "Dee: I play the drum at night."], "None"),
]


@pytest.mark.parametrize("question, texts, want", CASES)
def test_spans(question, texts, want):
    assert answer.spans(answer.Question(question), [answer.Packet(t, 1.0) for t in texts]) == want


def test_other_strategies():
    q, texts = answer.Question("What does Ann drink?"), ["Ann likes tea because it is warm. Ann sleeps.", "Bob drinks milk."]
    packets = [answer.Packet(t, 0.5) for t in texts]
    assert answer.basic(q, packets) == "Ann likes tea because it is warm" and answer.typed(q, packets) == "Ann likes tea"
    assert answer.basic(q, []) == answer.UNKNOWN and answer.composed(q, []) == answer.UNKNOWN
    when = answer.Question("When was it?")
    assert answer.dates_first(when, [answer.Packet("It was in May 1999 or so.")]) == "It was in May" and answer.dates_first(when, [answer.Packet("no idea")]) == "no idea"
    met = answer.Packet("we met last week", 1.0, {"event_time": "8 May 2023"})
    assert answer.by_metadata("last week", [met]) == "week before 8 May 2023" and answer.by_metadata("noon", [met]) == "noon"
    known = answer.Packet("[observation] user work a baker", 0.4, {"memory_kind": "observation", "relation": "work", "object": "a baker in town"})
    assert answer.composed(answer.Question("What is my job?"), [known]) == "a baker in town"


def test_model_answers():
    q, packets = answer.Question("When did Ann paint?"), [answer.Packet("Ann painted last year.", 0.5, {"event_time": "8 May 2023"})]
    assert answer.time_matters(q, packets) and not answer.time_matters(q, [answer.Packet("Ann painted last year.")])
    request = answer.prompt(q, packets, "fixture")
    assert "Relative time reasoning" in request.messages[1].content
    good = FixtureProvider({request_hash(request): " 2022.\n"})
    assert answer.model_answerer(good)(q, packets) == "2022" and answer.model_answerer(FixtureProvider({}))(q, packets).startswith("I don't know. LLM_ERROR")
    assert answer.model_answerer(FixtureProvider({}), answer.spans)(q, packets) == "last year"


def test_answered_rows(spark):
    schema = "query_id long, text string, evidence array<struct<content:string,score:double,metadata:map<string,string>,id:string>>"
    rows = [(1, "Where do I swim?", [("I relax near Lake Baths before work.", 0.5, {"a": "b"}, "m")]), (2, None, []), (3, "x", None), (4, "x", [(None, None, None, None)])]
    got = {r.query_id: r.answer for r in answer.answered(spark.createDataFrame(rows, schema), "span").collect()}
    assert got == {1: "Lake Baths", 2: answer.UNKNOWN, 3: answer.UNKNOWN, 4: answer.UNKNOWN}


def test_rerankers(spark):
    def p(i, score, content="x", source=None, **meta):
        return {"id": i, "score": score, "content": content, "metadata": meta, "source_event_id": source, "reasons": []}

    assert rerank.bonus("What fields did Ann research?", p("a", 0, "psychology research", subject="Ann")) == 1.5 and rerank.bonus("when?", p("a", 0, "in may", event_time="x")) == pytest.approx(0.4)
    pool = [p("a", 0.5, source="s"), p("b", 0.45, source="s"), p("c", 0.1, "he moved in may", source="t"), p("d", 0.0)]
    got = rerank.by_bonus("where did he go", pool, pool=3, kept=2)
    assert [x["id"] for x in got] == ["a", "b", "c", "d"] and got[0]["reasons"] == ["heuristic_rerank"] and got[1]["reasons"] == []
    assert [x["id"] for x in rerank.by_bonus("where did he go", pool, kept=3)] == ["a", "c", "b", "d"]
    assert [x["id"] for x in rerank.by_nudge("how many times", [p("a", 0.3, "really?", "s"), p("b", 0.2, "it was twice so", "s"), p("c", 0.1)])] == ["b", "c", "a"]
    known = ["m1", "m2", "m3"]
    assert rerank.chosen_ids('{"ids": ["m3", 1, {"id": "m2"}, true, 9]}', known) == ["m3", "m1", "m2"] and rerank.chosen_ids("first m2 then m1", known) == ["m2", "m1"]
    assert [x["id"] for x in rerank.reordered(pool, ["c", "zz", "c", "a"], 1)] == ["c", "a", "b", "d"]
    answer_text = json.dumps(["one of these", "ab", " another wording ", 4, "third way", "fourth way"])
    assert rerank.variants(answer_text) == ["one of these", "another wording", "third way"]
    for bad in ("x", "{}", "[]"):
        with pytest.raises(LlmError):
            rerank.variants(bad)
    q = spark.createDataFrame([(1, "who?")], "query_id long, text string")
    assert [tuple(r) for r in rerank.expanded(q, FixtureProvider({})).collect()] == [(1, 0, "who?")]
    schema = f"query_id long, text string, candidates array<{evidence.PACKET}>"
    rows = [(1, "where did he go", [(x["id"], x["content"], "episodic", {}, 0.5, x["source_event_id"], x["score"], []) for x in pool])]
    assert [c.id for c in rerank.reranked(spark.createDataFrame(rows, schema)).first().candidates] == ["a", "c", "d", "b"]


def test_primary_and_order():
    def p(i, source, content="x", score=0.5, **meta):
        return {"id": i, "source_event_id": source, "content": content, "metadata": meta, "score": score, "reasons": []}

    pool = [p("a", "s1"), p("b", "s2"), p("c", "s1", "he lives in Rome"), p("d", "s3", "he lives in Oslo"), p("e", "s4", "he lives in Bern")]
    assert [x["id"] for x in evidence.primary("where does he live", pool, 2)] == ["a", "d"]  # c has a source that is there
    assert [x["id"] for x in evidence.primary("where does he live", [*pool[:2], *pool[3:]], 2)] == ["a", "e"]  # d, then e in its place
    assert [x["id"] for x in evidence.primary("who is he", pool, 2)] == ["a", "b"] and evidence.primary("x", [], 3) == []
    got = evidence.in_order([p("a", "s2", "t", 0.1), p("b", "s1", "t", 0.4), p("c", None, "z"), p("d", "s1", "b")])
    assert [x["id"] for x in got] == ["c", "d", "b"]
    pack = evidence.Pack("source-window")
    assert (pack.sources, pack.windows, pack.sources_first, pack.observations, pack.primary_limit, pack.search_limit) == (True, True, False, 4, 10, 50)
    assert evidence.Pack("two-stage", 10).search_limit == 200 and evidence.Pack("primary").observations == 0 and evidence.Pack("x", 7, False).search_limit == 7
    hit, again = p("m1", "s1"), p("m2", "s1", "w", memory_kind="verbatim_turn")
    assert [x["id"] for x in evidence.assembled([hit], [again, p("m3", "s1", "v"), hit], pack)] == ["m2", "m1"]


def test_dates():
    yes = [("3 march 2021", "5 march 2021"), ("12 march 2021", "friday before 13 march 2021"), ("15 march 2021", "monday after 13 march 2021"), ("week of march 10 2021", "week before 17 march 2021"), ("9 march 2021", "week of 12 march 2021"), ("31 january 2021", "2 february 2021")]
    no = [("3 march 2021", "6 march 2021"), ("3 march 2021", ""), ("week of 1 march 2021", "week of 10 march 2021"), ("march 2021", "3 march 2021")]
    assert all(dates.same_date(a, b) and dates.same_date(b, a) for a, b in yes) and not any(dates.same_date(a, b) for a, b in no)
    assert dates.relative_date("saturday before 13 march 2021".split()).isoformat() == "2021-03-13" and dates.day_of(2021, 2, 31).isoformat() == "2021-03-03"


def test_judges(spark):
    rows = [("ten miles off", ["10 miles"]), ("a red barn", ["The red barn"]), ("", ["x"]), ("On  Monday", ["monday", "y"]), ("4 May 2020", ["6 May 2020"]), ("no", ["yes"]), (None, None), ("x", [])]
    df = spark.createDataFrame(rows, "answer string, gold_answers array<string>")
    assert [r.correct for r in evaluate.judged(df, "normalized").collect()] == [True, True, False, True, True, False, False, False]
    assert [r.correct for r in evaluate.judged(df, "exact").collect()] == [False, False, False, True, False, False, False, False]
    assert df.limit(3).select(evaluate.exact_judge(F.col("answer"), F.col("gold_answers"), True).alias("c")).collect()[2].c is True


def test_summary_and_misses(spark):
    rows = [(1, ["a"], ["a", None, "b"], True), (2, ["a"], ["b"], False), (3, [], ["a"], None), (4, ["c", "d"], ["x", "c"], False)]
    m = evaluate.metrics(spark.createDataFrame(rows, "query_id long, evidence array<string>, retrieved array<string>, correct boolean"), keep=("correct", "retrieved", "evidence"))
    s = evaluate.summarize(m).first()
    assert (s.questions, s.answered, s.miss_10, s.wrong_with_evidence, s.wrong_with_first) == (4, 3, 0.5, 0.25, 0.0) and s.accuracy == pytest.approx(1 / 3) and s.recall_200 == pytest.approx(1.5 / 4)
    assert [r.query_id for r in evaluate.missed(m, 1).collect()] == [2] and evaluate.summarize(m.drop("correct")).first().accuracy is None
    assert sorted((r.query_id, r.gold, r["rank"]) for r in evaluate.gold_ranks(m).collect() if r.query_id != 3) == [(1, "a", 1), (2, "a", None), (4, "c", 2), (4, "d", None)]


def test_equal_texts_are_parsed_once_by_the_date_judge(monkeypatch):
    from recallforge.functions import dates

    seen, plain = [], dates.calendar_date
    monkeypatch.setattr(dates, "calendar_date", lambda tokens: seen.append(tuple(tokens)) or plain(tokens))
    dates.meant.cache_clear()
    try:
        assert all(dates.same_date("7 may 2023", g) for g in ("8 may 2023", "week of 9 may 2023") * 50)
        assert not dates.same_date("7 may 2023", "70 may 2023") and len(seen) <= 8
    finally:
        dates.meant.cache_clear()


def test_lenient_judge_of_nulls(spark):
    from pyspark.sql import functions as F

    from recallforge.operators import evaluate

    rows = [("7 May 2023", None, None), ("", None, False), (None, ["x"], False), ("an Apple", ["apple pie", None], True), ("x", [None, ""], False), ("Friday before 9 May 2023", ["5 May 2023"], True)]
    got = spark.createDataFrame([r[:2] for r in rows], "a string, g array<string>").select(evaluate.lenient_judge(F.col("a"), F.col("g")).alias("x"), evaluate.lenient_judge(F.col("a"), F.col("g"), True).alias("y")).collect()
    assert [r.x for r in got] == [r[2] for r in rows] and [r.y for r in got] == [None, None, True, True, False, True]
