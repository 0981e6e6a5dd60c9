"""Datasets, observations, extraction by models, runs, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from recallforge import benchmark, cli, providers
from recallforge.operators import extract, ingest, observe
from recallforge.providers import Config, FixtureProvider, LlmError, Message, Request, request_hash
from recallforge.sources import datasets
from recallforge.streaming import state

TALK = {
    "conversations": [{
        "id": "c1",
        "turns": [{"id": "t1", "speaker": "user", "text": "My preferred town is Lakeside. I moved there last year."}, {"id": "t2", "speaker": "assistant", "text": "Noted, Lakeside is your preferred town."}],
        "questions": [{"id": "q1", "question": "Which town does the user prefer?", "answers": ["Lakeside"], "evidence": ["t1"], "category": "one"}],
    }]
}


def test_layouts():
    talk = [{"sample_id": "s", "conversation": {"session_2": [{"dia_id": "D2:1", "speaker": "A", "text": "late"}], "session_10": [{"text": "last"}], "session_1": [{"dia_id": "D1:1", "speaker": "A", "text": "first"}, {"text": ""}], "session_1_date_time": "1 May 2020", "session_x": []},
             "qa": [{"question": "why?", "category": 5}, {"question": "who?", "answer": 7, "evidence": ["D1:1"], "category": 1}, {"answer": "no question"}]}]
    (name, turns), questions = datasets.parse_dataset(talk, "locomo")[0][0], datasets.parse_dataset(talk, "locomo")[1]
    assert name == "s" and [(t.id, t.text, t.timestamp) for t in turns] == [("s::D1:1", "first", "1 May 2020"), ("s::D2:1", "late", None), ("s::s10:t0", "last", None)]
    assert [(q.id, q.gold_answers, q.evidence_turn_ids) for q in questions] == [("s:q:0", ["None"], []), ("s:q:1", ["7"], ["s::D1:1"])]
    hay = [{"question_id": "q", "question": "what?", "answer": "x", "question_type": "t", "haystack_session_ids": ["a"], "haystack_dates": ["d1"], "haystack_sessions": [[{"role": "user", "content": "hi", "has_answer": True}, {"content": ""}], [{"content": "ho"}]], "answer_session_ids": ["a"]}]
    conversations, (question,) = datasets.parse_dataset(hay, "lme")
    assert [(t.id, t.speaker, t.timestamp) for t in conversations[0][1]] == [("q::session:0:a:turn:0", "user", "d1"), ("q::session:1:q:session:1:turn:0", "unknown", None)] and question.evidence_turn_ids == ["q::session:0:a:turn:0"]
    hay[0]["haystack_sessions"][0][0]["has_answer"] = False
    assert datasets.parse_dataset(hay, "longmemeval")[1][0].evidence_turn_ids == ["q::a"]


def test_lenient_layout():
    nested = {"data": [{"dialogueId": 4, "sessions": [{"turns": [{"utterance": "a"}, {"messages": [{"content": "b", "role": "r", "time": "t"}]}]}], "qas": [{"query": "q", "target": [None, True, {"answer": "z"}, 2.5]}]}]}
    conversations, (q,) = datasets.parse_dataset(nested)
    assert [(t.id, t.speaker, t.text, t.timestamp) for t in conversations[0][1]] == [("4:turn:0", "unknown", "a", None), ("4:turn:1", "r", "b", "t")] and q.gold_answers == ["None", "z", "2.5"]
    own = {"name": "n", "version": "v", "conversations": [{"id": "c", "turns": [{"id": "t", "speaker": "s", "text": "x"}]}], "questions": [{"id": "q", "conversation_id": "c", "text": "y", "gold_answers": [], "evidence_turn_ids": []}]}
    assert datasets.parse_dataset(own)[1][0].id == "q"
    for bad, why in (([], "records"), ([{"turns": []}], "turns"), ([{"turns": [{"text": "x"}]}], "questions")):
        with pytest.raises(datasets.DatasetError, match=why):
            datasets.parse_dataset(bad)


def test_run_of_a_dataset(spark, tmp_path, capsys):
    path = tmp_path / "talk.json"
    path.write_text(json.dumps(TALK))
    turns, questions = datasets.load_dataset(spark, str(path))
    assert [r.id for r in turns.orderBy("turn_index").collect()] == ["t1", "t2"] and datasets.for_answerer(questions).columns == ["id", "conversation_id", "text", "category"]
    assert "evidence_turn_ids" not in datasets.for_judge(questions).columns and datasets.check_no_gold(datasets.for_answerer(questions)) is not None
    with pytest.raises(datasets.DatasetError):
        datasets.check_no_gold(questions)
    some, needed = datasets.selected(questions, turns, 1)
    assert some.count() == needed.count() == 0
    assert [tuple(r) for r in datasets.evidence_audit(questions, turns).collect()] == [("c1", 1, 1, 0)]
    memories = {(r.metadata["memory_kind"], r.metadata.get("verbatim_form")): r for r in ingest.ingest_dataset(turns).collect() if r.metadata and "memory_kind" in r.metadata}
    assert memories["verbatim_session", None].content == "[verbatim_session]\nuser: My preferred town is Lakeside. I moved there last year.\nassistant: Noted, Lakeside is your preferred town.\n"
    assert memories["observation", None].metadata["side_channel"] == "observation"
    for mode in ("retrieval", "answer"):
        config = benchmark.RunConfig(str(path), mode=mode, answerer="span", judge="normalized", reranker="heuristic", output=str(tmp_path / mode))
        report = benchmark.load_and_run(spark, config)
        s = report.summary.first()
        assert s.questions == 1 and s.recall_5 == 1.0 and (s.answered, s.accuracy) == ((1, 1.0) if mode == "answer" else (0, None))
        assert {p.name for p in (tmp_path / mode).iterdir()} == {"manifest.json", "summary.json", "scores.jsonl", "report.md"} and benchmark.read_scores(spark, str(tmp_path / mode)).count() == 1
    assert cli.main(["bench", "--dataset", str(path), "--top-k", "3"], spark) == 0 and "recall_1 |" in capsys.readouterr().out
    assert cli.main(["missed", "--dataset", str(path)], spark) == 0 and cli.main(["bench", "--dataset", "x", "--kind", "zz"], spark) == 2


def test_json_texts(spark):
    rows = [('"a"',), ("7",), ("null",), ('["a", 1, null, true]',), ("true",), ('{"a": 1}',), ("not json",), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "j string").select(datasets.json_texts(F.col("j")).alias("t")).collect()]
    assert got == [["a"], ["7"], ["None"], ["a", "1", "None"], [], [], [], []]


def test_observations(spark):
    said = {
        "The lamp was a gift from my aunt in town": ("attribute", "gift_from", "from aunt in town"), "I redeemed the coupon at the corner shop today": ("attribute", "redeemed_at", "the corner shop today"),
        "We bought it from a small shop, really": ("attribute", "purchase_location", "a small shop"), "My line has 300 Mbps now": ("attribute", "quantity", "300 Mbps now"),
        "Bob said I prefer tea": ("preference", "prefers", "Bob said user prefers tea"), "My favorite color is dark blue": ("preference", "has_favorite", "color is dark blue"),
        "Now I work at the mill": ("update", "work", "Now user works at the mill"), "Ann met us before noon": ("temporal", "happened_at_or_near", "Ann met us before noon"), "too short": None, "plain words here": None,
    }
    for text, want in said.items():
        got = observe.observe(text, "human 1")
        assert (got and (got["kind"], got["relation"], got["object"])) == want, text
    assert observe.observe("Ann met us before noon", "x")["subject"] == "Ann" and observe.observe("the mill burned last week", "the agent")["subject"] == "assistant"
    turns = spark.createDataFrame([("n", "e", "user", "Bob said I prefer tea. plain words here", "4 May"), ("n", "f", "user", None, None)], "namespace string, event_id string, actor string, text string, timestamp string")
    found = observe.observations(turns)
    m, p = observe.as_memories(found).first(), observe.as_memories(found, profile=True).first()
    assert m.content == "[preference] user prefers Bob said user prefers tea" and m.importance == 0.58 and m.metadata["event_time"] == "4 May" and m.metadata["entities"] == "bob\nuser"
    assert p.content == "[profile] user prefers: Bob said user prefers tea" and (p.importance, p.confidence) == (0.56, 0.64) and "side_channel" not in p.metadata


def test_tolerant_json():
    fact = [{"fact": "a"}]
    readable = {
        '{"facts": ["a", " ", {"content": "b"}, 3]}': [{"fact": "a"}, {"content": "b"}], '```json\n{"facts": ["a"]}\n```': fact, 'Sure: {"facts": ["a"]} done': fact, 'So [{"fact": "a"}] it is': fact,
        '{"memories": [{"fact": "a"}, {"fact": "b"}, {"fa': [{"fact": "a"}, {"fact": "b"}], '[{"fact": "a"}, {"fact": "b': fact, '[{"fact": "a': fact, '{"fact": "a"}\n{"fact": "b"}\nnoise': [{"fact": "a"}, {"fact": "b"}],
        '{"memory": {"fact": "a"}}': [{"memory": {"fact": "a"}}], '{"memories": [{"fact": "a } ] \\" b"}]}': [{"fact": 'a } ] " b'}],
    }
    for text, want in readable.items():
        assert extract.memory_items(text) == want, text
    for bad in ("", "``` ```", "nothing", "{", "[]", "{}", '{"facts": []}'):
        with pytest.raises(LlmError):
            extract.memory_items(bad)
    assert extract.repaired('{"a": [1, 2,') == '{"a": [1, 2}]' or extract.repaired('[1, {"b": "c') == '[1, {"b": "c"}]'
    assert extract.repaired("") is None and extract.repaired("{") is None and extract.repaired('["x\\"y') == '["x\\"y"]'


def test_memories_of_items():
    event = {"namespace": "n", "event_id": "e", "actor": "Ann", "text": "The mental health support group met yesterday, and the LGBTQ walk", "timestamp": "4 May"}
    words = extract.keywords("Ann", event["text"], "4 May")
    assert words[:6] == ["Ann", "4 May", "yesterday", "support group", "mental health", "identity"] and "met" in words and "The" not in words and len(words) <= 14
    m = extract.memory_of({"content": " x ", "type": "preference", "importance": 7, "entities": ["A", " "], "subject": " s ", "source_keywords": ["k"]}, event)
    assert (m["memory_type"], m["content"], m["importance"], m["confidence"]) == ("reflection", "x", 1.0, 0.7) and m["metadata"] == {"memory_kind": "llm_fact", "speaker": "Ann", "subject": "s", "entities": "A\nk", "source_keywords": "k"}
    assert extract.memory_of({"fact": "x", "type": "zz"}, event)["memory_type"] == "episodic" and extract.memory_of({"fact": "x"}, event)["memory_type"] == "semantic"
    assert extract.memory_of({"memory": {"text": "y"}}, event)["content"] == "y" and extract.memory_of({"fact": " "}, event) is None and extract.memory_of("x", event) is None


def test_extraction_by_a_model(spark):
    turns = spark.createDataFrame([("n", f"e{i}", "Ann", f"I like walking number {i} very much") for i in range(3)], "namespace string, event_id string, actor string, text string")
    events = [{"namespace": r.namespace, "event_id": r.event_id, "actor": r.actor, "text": r.text, "timestamp": None} for r in turns.collect()]
    answers = FixtureProvider({request_hash(extract.request_for(events[0])): '{"facts": ["Ann walks", "Ann rests"]}', request_hash(extract.request_for(events[1])): '{"facts": []}'})
    found = sorted((r.event_id, r.pos, r.content, r.memory_type) for r in extract.llm_candidates(turns, answers).collect())
    assert found == [("e0", 0, "Ann walks", "semantic"), ("e0", 1, "Ann rests", "semantic"), ("e2", 0, "I like walking number 2 very much", "semantic")]


def test_providers(spark, tmp_path):
    a, b = Request([Message("user", "x")], model="m"), Request([Message("user", "y")], model="m")
    assert request_hash(a) == request_hash(Request([Message("user", "x")], model="m")) != request_hash(b)
    path = str(tmp_path / "deep" / "answers.jsonl")
    calls = []

    def post(url, body, headers, timeout):
        calls.append((url, body["messages"][0]["content"], headers, timeout))
        return {"choices": [{"message": {"content": " ", "reasoning_content": "thought"}}]}

    chat = providers.ChatProvider(Config("chat", "m", "http://h/v1/", "key", path, 5.0), post)
    assert chat.complete(a) == chat.complete(a) == "thought" and calls == [("http://h/v1/chat/completions", "x", {"Authorization": "Bearer key"}, 5.0)]
    providers.append_record(path, request_hash(a), "newer")
    replay = providers.provider(Config("fixture", path=path))
    assert replay.complete(a) == "newer" and replay.metadata()["provider"] == "fixture" and providers.fixture_table(spark, path).collect()[0].response == "newer"
    with pytest.raises(LlmError):
        replay.complete(b)
    for bad in (Config("zz"), Config("fixture", path="/nowhere"), Config("chat")):
        with pytest.raises(LlmError):
            providers.provider(bad)
    for body in ({}, {"choices": []}, {"choices": [{"message": {"content": ""}}]}):
        with pytest.raises(LlmError):
            providers.message_content(body)
    env = {"RECALLFORGE_LLM_MODEL": "big", "RECALLFORGE_EXTRACTOR_MODEL": "small", "RECALLFORGE_LLM_TIMEOUT": "9", "RECALLFORGE_EXTRACTOR_MAX_TOKENS": "0"}
    got = providers.extractor_config(env)
    assert (got.model, got.timeout, got.max_tokens, Config.from_env(env=env).model) == ("small", 9.0, 16384, "big")
    with pytest.raises(LlmError):
        Config.from_env(env={"RECALLFORGE_LLM_TIMEOUT": "soon"})
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k long, t string")
    out = providers.answered(rows, replay, lambda r: Request([Message("user", r["t"])], model="m")).orderBy("k").collect()
    assert out[0].response == "newer" and out[0].error is None and out[1].response is None and "no recorded answer" in out[1].error


def micro_batches(spark, make, batches, schema, tmp_path):
    """The rows that a stream gives over the batches, with a restart from its checkpoint after each."""
    source, out = tmp_path / "in", tmp_path / "out"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))

        def keep(df, k, i=i):
            df.withColumn("_b", F.lit(i * 1000 + k)).write.mode("append").parquet(str(out))

        stream.writeStream.outputMode(make.mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(str(out))


TURN = "namespace string, seq long, actor string, text string"


@pytest.mark.parametrize("cut", [3, 8])
def test_streamed_windows_equal_batch(spark, tmp_path, cut):
    rows = [(f"c{i % 2}", i, "u", f"t{i}") for i in range(13)]
    ends = [("c0", 99, "u", None), ("c1", 99, "u", None)]

    def make(stream):
        return state.stream_windows(stream, 4)

    make.mode = "append"
    got = {(r.namespace, r.window, r.full, r.n_turns, r.combined) for r in micro_batches(spark, make, [rows[:cut], rows[cut:], ends], TURN, tmp_path).drop("_b").collect()}
    assert got == {tuple(r) for r in ingest.windows(spark.createDataFrame(rows, TURN), 4).collect()}


def test_buffer():
    with pytest.raises(ValueError):
        state.Buffer(0)
    b = state.Buffer(3)
    assert [b.push("u", str(i)) is not None for i in range(5)] == [False, False, True, False, True] and b.flush()[:2] == (2, False) and b.flush() is None and b.made == 0


def test_streamed_merges_equal_batch(spark, tmp_path):
    texts = ["I like tea", "green hills far away", "i LIKE tea", "green hills far away now", "other", "I like tea"]
    rows = [(f"m{i}", "n", "semantic", t, f"e{i}", 0.1 * i, 0.5, {"k": str(i)} if i != 4 else {"side_channel": "x"}, i) for i, t in enumerate(texts)]
    schema = "id string, namespace string, memory_type string, content string, source_event_id string, importance double, confidence double, metadata map<string,string>, seq long"

    def make(stream):
        return state.stream_fold(stream)

    make.mode = "update"
    versions = micro_batches(spark, make, [rows[:2], rows[2:3], rows[3:]], schema, tmp_path)
    last = versions.groupBy("id").agg(F.max_by(F.struct("content", "importance", "merged", F.array_sort(F.map_entries("metadata")).alias("m")), F.struct("_b", "merged")).alias("x")).select("id", "x.*")
    batch = ingest.fold(spark.createDataFrame(rows, schema)).select("id", "content", "importance", "merged", F.array_sort(F.map_entries("metadata")).alias("m"))
    assert sorted(map(str, last.collect())) == sorted(map(str, batch.collect())) and batch.count() == 3
