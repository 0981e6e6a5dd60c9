"""The record log, the stores, the engine and its service."""

import io
import json

import pytest
from pyspark.sql import functions as F

from recallforge import schema
from recallforge.engine import MemoryEngine
from recallforge.schema import CorruptStore, DuplicateEvent, MemoryQuery, StoreError
from recallforge.service import BAD_PARAMS, FAILED, UNKNOWN_METHOD, Service, read_message
from recallforge.sources import log
from recallforge.sources.store import FileStore, TableStore, VolatileStore



def now():
    return F.lit("2024-01-10 12:00:00").cast("timestamp")

SEQ = "seq struct<batch:long,file:string,start:long,row:long>, line string"


def lines(spark, *texts):
    return spark.createDataFrame([((0, "f", 0, i), t) for i, t in enumerate(texts)], SEQ)


def test_escapes_go_both_ways(spark):
    texts = ["", "a\tb\nc\rd=e;f\\g", "\\", "\\\\t", "\\t\t\\", "plain é 😀", "x\\0y", "a\x0bb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", log.escape(F.col("t")).alias("e")).withColumn("u", log.unescape(F.col("e")))
    assert [(r.t, r.u) for r in df.collect()] == [(t, t) for t in texts] and all("\t" not in r.e and "=" not in r.e for r in df.collect())
    bad = spark.createDataFrame([("a\\x",), ("a\\",), ("\\0",)], "t string")
    assert [r.u for r in bad.select(log.unescape(F.col("t")).alias("u")).collect()] == [None] * 3


def test_metadata_goes_both_ways(spark):
    maps = [{}, {"a": "1"}, {"é=;": "\t", "b": ""}]
    from recallforge.functions.text import hex_pairs

    df = spark.createDataFrame([(m,) for m in maps], "m map<string,string>").withColumn("h", hex_pairs(F.col("m")))
    assert [r.m for r in df.select(log.unhex_pairs(F.col("h")).alias("m")).collect()] == maps and df.collect()[1].h == "61=31"
    bad = spark.createDataFrame([("6=31",), ("61",), ("zz=31",), ("ff=31",), ("61=31;61=32",)], "h string")
    assert [r.m for r in bad.select(log.unhex_pairs(F.col("h")).alias("m")).collect()] == [None, None, None, None, {"a": "2"}]


def test_replay_of_records(spark):
    m = "memory\tm1\tns\tsemantic\tone\\ttwo\t\t0.500000\t0.750000\t\t100\t100\t\t\t\t"
    rows = lines(spark, "event\te1\tns\tuser\thello\t61=31\t100", "  ", m, "delete\tm1\t200", "delete\tzz\t200", m.replace("m1", "m2").replace("one", "x"), "delete\tm2\t150", m.replace("m1", "m2").replace("semantic", "plan"))
    parsed = log.checked(log.parse(rows))
    events, memories = log.replay_events(parsed).collect(), {r.id: r for r in log.replay_memories(parsed).collect()}
    assert [(r.id, r.actor, r.metadata, r.created_at.timestamp()) for r in events] == [("e1", "user", {"a": "1"}, 100.0)]
    assert memories["m1"].content == "one\ttwo" and memories["m1"].deleted_at.timestamp() == 200 and memories["m1"].source_event_id is None
    assert set(memories) == {"m1", "m2"} and memories["m2"].deleted_at is None and memories["m2"].memory_type == "episodic"


@pytest.mark.parametrize("line, message", [
    ("event\te1", "event record must have 7 fields"), ("memory\tx", "memory record must have 15 fields"), ("delete\tx", "delete record must have 3 fields"), ("other\tx", "unknown record type: other"),
    ("delete\tx\tsoon", "invalid timestamp"), ("event\te\tn\tu\tbad\\x\t\t1", "invalid escape"), ("event\te\tn\tu\tt\tzz\t1", "invalid metadata"), ("memory\tm\tn\tsemantic\tc\t\thigh\t0.5\t\t1\t1\t\t\t\t", "invalid importance"),
])
def test_corrupt_records(spark, line, message):
    with pytest.raises(CorruptStore, match=f"line 2: {message}"):
        log.checked(log.parse(lines(spark, "delete\tx\t1", line)))


def memory_rows(spark, *rows):
    """(id, namespace, type, content, metadata, updated second) as memories."""
    df = spark.createDataFrame(list(rows), "id string, namespace string, memory_type string, content string, metadata map<string,string>, at long")
    return schema.memories(df.withColumns({"created_at": F.timestamp_seconds("at"), "updated_at": F.timestamp_seconds("at")}).drop("at"), now())


def stores(spark, tmp_path):
    return [FileStore(spark, str(tmp_path / "log"), now()), VolatileStore(spark, now()), TableStore(spark, str(tmp_path / "tables"), now())]


def test_stores_agree_on_writes_and_differ_in_listings(spark, tmp_path):
    rows = memory_rows(spark, ("m1", "a", "semantic", "x\ty", {"k": "v"}, 30), ("m2", "a", "episodic", "two", {}, 10), ("m3", "a", "semantic", "three", {"side_channel": "o"}, 40), ("m4", "b", "semantic", "four", {}, 20))
    for store in stores(spark, tmp_path):
        store.add_memories(rows)
        store.add_events(schema.events(spark.createDataFrame([("e1", "hi", "a"), ("e2", "ho", "b")], "id string, text string, namespace string"), now()))
        assert [(r.id, r.actor) for r in store.list_events("a").collect()] == [("e1", "user")]
        assert store.get_memory("m1").first().metadata == {"k": "v"} and store.get_memory("m1").first().content == "x\ty"
        assert sorted(r.id for r in store.list_memories(MemoryQuery(namespace="a")).collect()) == ["m1", "m2"]
        assert [r.id for r in store.list_memories(MemoryQuery(namespace="a", memory_types=["episodic"])).collect()] == ["m2"]
        assert sorted(r.id for r in store.list_memories(MemoryQuery(namespace="a", include_side_channel=True)).collect()) == ["m1", "m2", "m3"]
        few = sorted(r.id for r in store.list_memories(MemoryQuery(namespace="a", limit=1)).collect())
        assert few == {FileStore: ["m1", "m2"], VolatileStore: ["m1"], TableStore: []}[type(store)]  # the table's latest is a side channel
        store.update_memories(rows.filter("id = 'm2'").withColumn("content", F.lit("changed")))
        found = store.get_memory("m2").first()
        assert found.content == "changed" and (found.updated_at.timestamp() == 10) == isinstance(store, VolatileStore)
        with pytest.raises(StoreError):
            store.delete_in("b", spark.createDataFrame([("m1",)], "id string"))
        store.delete_in("a", spark.createDataFrame([("m1",)], "id string"))
        store.delete_memories(spark.createDataFrame([("nobody",)], "id string"))
        assert store.get_memory("m1").count() == 0 and store.memories().count() == 4 and store.list_memories(MemoryQuery(namespace="b")).count() == 1


def test_duplicate_events(spark, tmp_path):
    event = schema.events(spark.createDataFrame([("e1", "hi")], "id string, text string"), now())
    file, volatile, tables = stores(spark, tmp_path)
    for store in (file, volatile):
        store.add_events(event)
        store.add_events(event.withColumn("text", F.lit("ho")))
        assert [r.text for r in store.events().collect()] == ["ho"]
    tables.add_events(event)
    with pytest.raises(DuplicateEvent):
        tables.add_events(event)


def test_expired_memories(spark, tmp_path):
    rows = memory_rows(spark, ("m1", "default", "semantic", "old", {}, 1), ("m2", "default", "semantic", "now", {}, 2), ("m3", "default", "semantic", "later", {}, 3))
    day = F.expr("interval 1 day")
    rows = rows.withColumns({"valid_to": F.when(F.col("id") == "m1", now() - day), "valid_from": F.when(F.col("id") == "m3", now() + day)})
    for store in stores(spark, tmp_path):
        store.add_memories(rows)
        assert [r.id for r in store.list_memories(MemoryQuery()).collect()] == ["m2"] and store.list_memories(MemoryQuery(include_expired=True)).count() == 3


def test_engine(spark, tmp_path):
    for store in stores(spark, tmp_path)[::2]:  # the service's test has the third
        engine = MemoryEngine(store)
        events = spark.createDataFrame([("e1", "I prefer green tea in the morning. We walked to the old mill.", "a"), ("e2", "i PREFER green tea in the morning", "a"), ("e3", "I like black coffee at night", "b")], "id string, text string, namespace string")
        written = engine.ingest(events)
        assert sorted((r.namespace, r.memory_type) for r in written.collect()) == [("a", "episodic"), ("a", "semantic"), ("b", "semantic")]
        engine.ingest(spark.createDataFrame([("e4", "I prefer green tea in the morning", "a")], "id string, text string, namespace string"))
        assert store.list_memories(MemoryQuery(namespace="a")).count() == 2
        hits = engine.search([MemoryQuery("green tea", "a"), MemoryQuery("green tea", "b"), MemoryQuery("green tea", "a", ["episodic"])]).collect()
        top = {q: next(r for r in hits if r.query_id == q and r["rank"] == 1) for q in (0, 1, 2)}
        assert "green tea" in top[0].content and "coffee" in top[1].content and "mill" in top[2].content and "keyword_match" in top[0].reasons
        context = engine.build_context(MemoryQuery("green tea", "a"))
        assert context.startswith("# Agent Memory\n- [semantic score=") and context.endswith("\n") and engine.build_context(MemoryQuery("x", "nowhere")) == ""
        engine.delete_memories("a", [top[0].id])
        assert all("green" not in r.content for r in engine.search([MemoryQuery("green tea", "a")]).collect())
        with pytest.raises(StoreError):
            engine.delete_memories("a", [top[0].id])


def test_engine_with_windows(spark):
    engine = MemoryEngine(VolatileStore(spark, now()), buffer=2)
    engine.ingest(spark.createDataFrame([(f"e{i}", f"We talked about the number {i} for long", "a") for i in range(3)], "id string, text string, namespace string"))
    contents = [r.content for r in engine.store.list_memories(MemoryQuery(namespace="a", limit=99)).collect()]
    assert contents and any("Turn 1 — user: We talked about the number" in c for c in contents)
    with pytest.raises(ValueError):
        MemoryEngine(VolatileStore(spark), buffer=0)


def test_defaults(spark):
    e = schema.events(spark.createDataFrame([("hi",)], "text string"), now()).first()
    m = schema.memories(spark.createDataFrame([("c", 7.0, "goal")], "content string, importance double, memory_type string"), now()).first()
    assert (e.actor, e.namespace, e.metadata) == ("user", "default", {}) and e.id.startswith("evt_")
    assert (m.importance, m.confidence, m.memory_type, m.namespace) == (1.0, 0.75, "episodic", "default") and m.updated_at == m.created_at
    assert schema.dataset_kind("LME") == "longmemeval" and schema.run_mode("qa") == "answer" and schema.dataset_hash(b"x") == schema.dataset_hash(b"x")
    for call in (schema.dataset_kind, schema.run_mode):
        with pytest.raises(ValueError):
            call("nothing")


def test_service(spark):
    service = Service(MemoryEngine(VolatileStore(spark, now())))

    def ask(method, **params):
        return service.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})

    def call(name, **arguments):
        out = ask("tools/call", name=name, arguments=arguments)
        return json.loads(out["result"]["content"][0]["text"]) if "result" in out and name != "build_context" else out

    assert ask("initialize")["result"]["serverInfo"]["name"] == "recallforge" and ask("ping")["result"] == {} and ask("resources/list")["result"] == {"resources": []}
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["remember", "search", "build_context", "delete_memory"]
    ids = call("remember", text="I prefer quiet mornings by the lake", namespace="n", metadata={"a": "b", "c": 1})
    assert len(ids) == 1 and [h["id"] for h in call("search", query="quiet lake", namespace="n", limit=500)] == ids
    assert "quiet mornings" in call("build_context", query="lake", namespace="n")["result"]["content"][0]["text"]
    assert call("delete_memory", memory_id=ids[0], namespace="n") == {"deleted": True} and call("delete_memory", memory_id=ids[0], namespace="n")["error"]["code"] == FAILED
    for bad in ({"name": "search", "arguments": {}}, {"name": "search", "arguments": {"query": "x", "memory_types": ["y"]}}, {"name": "search", "arguments": {"query": "x", "limit": "y"}}, {"name": "zz"}, {}):
        assert ask("tools/call", **bad)["error"]["code"] == BAD_PARAMS
    assert ask("zz")["error"]["code"] == UNKNOWN_METHOD and service.handle({"method": "ping"}) is None and service.handle([])["error"]["code"] == BAD_PARAMS
    body = json.dumps({"jsonrpc": "2.0", "id": 2, "method": "ping"}).encode()
    out = io.BytesIO()
    service.serve_stream(io.BytesIO(b"Content-Length: %d\r\n\r\n%s" % (len(body), body) + b"\n" + body + b"\nnot json\n"), out)
    out.seek(0)
    replies = []
    while (m := read_message(out)) is not None:
        replies.append(json.loads(m))
    assert [r.get("result") for r in replies] == [{}, {}, None]


def test_service_over_http(spark):
    import threading
    import urllib.request

    server = Service(MemoryEngine(VolatileStore(spark, now()))).serve_http(port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    with urllib.request.urlopen(urllib.request.Request(url + "/mcp", b'{"id": 1, "method": "ping"}')) as got:
        assert json.loads(got.read())["result"] == {}
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(urllib.request.Request(url + "/other", b"{}"))
    server.shutdown()
