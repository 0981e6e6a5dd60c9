"""Queries of ingest, listings, the record log, judging, answers and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.functions import dates as D
from recallforge.functions.text import summary
from recallforge.operators import answer, asof, evaluate, evidence, ingest, observe, search
from recallforge.plans.registry import SENT, TOK, asked, memories, query, table, turns
from recallforge.plans.retrieval import _ALL, _BM, _EVIDENCE, _NAMES, _R, evaluated
from recallforge import schema
from recallforge.schema import MemoryQuery, memory_type
from recallforge.sources import datasets, log
from recallforge.sources.shared import Scratch, materialize
from recallforge.sources.snapshot import SnapshotStore
from recallforge.sources.store import TableStore
from recallforge.streaming import keyed

# ---- listings and the log: events as memories

_MEM = """SELECT 'm' || event_id AS id, 'ns' || user_id % 3 AS namespace, CASE event_type WHEN 'click' THEN 'semantic' WHEN 'view' THEN 'episodic' WHEN 'purchase' THEN 'procedural' ELSE 'episodic' END AS memory_type, props AS content,
CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'u=' || user_id END AS source_event_id, event_id, user_id, value, date_trunc('second', ts) AS ts FROM events"""


def event_memories(spark, sf_dir) -> DataFrame:
    """Events as memories: some side-channel, some deleted, valid for five days."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    kind = F.when(F.col("event_type") == "click", "semantic").when(F.col("event_type") == "purchase", "procedural").when(F.col("event_type") == "view", "episodic").otherwise(F.col("event_type"))
    meta = F.when(F.col("user_id") % 5 == 0, F.create_map(F.lit("side_channel"), F.lit("x"), F.lit("user"), F.col("user_id").cast("string"))).otherwise(F.create_map(F.lit("user"), F.col("user_id").cast("string")))
    return e.select(
        F.concat(F.lit("m"), "event_id").alias("id"), F.concat(F.lit("ns"), F.col("user_id") % 3).alias("namespace"), memory_type(kind).alias("memory_type"), F.col("props").alias("content"),
        F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("u="), "user_id")).alias("source_event_id"), F.least(F.col("value") / 100, F.lit(1.0)).alias("importance"), F.lit(0.5).alias("confidence"), meta.alias("metadata"),
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.col("ts").alias("valid_from"), (F.col("ts") + F.expr("interval 5 days")).alias("valid_to"), F.when(F.col("value") < 10, F.col("ts")).alias("deleted_at"),
    )


_NOW = "TIMESTAMP '2024-01-05 00:00:00'"
_VISIBLE = f"WITH m AS ({_MEM}), v AS (SELECT * FROM m WHERE value >= 10 AND ts <= {_NOW} AND ts + INTERVAL 5 DAY >= {_NOW})"


@query(f"{_VISIBLE} SELECT namespace, memory_type, count(*) AS n, CAST(min(event_id) AS BIGINT) AS first FROM v WHERE namespace = 'ns1' AND memory_type IN ('semantic', 'procedural') AND user_id % 5 <> 0 GROUP BY ALL")
def listing_filters(spark, sf_dir):
    """Namespace, types, deletes, validity and side channels in one listing."""
    seen = log.visible(event_memories(spark, sf_dir), "ns1", ["semantic", "procedural"], F.lit("2024-01-05 00:00:00").cast("timestamp"), side_channel=False)
    return seen.groupBy("namespace", "memory_type").agg(F.count("*").alias("n"), F.min(F.substring("id", 2, 20).cast("long")).alias("first"))


@query(f"{_VISIBLE} SELECT id, memory_type FROM (SELECT * FROM v WHERE namespace = 'ns2' ORDER BY ts DESC, id LIMIT 40) WHERE user_id % 5 <> 0")
def recent_before_side_channels(spark, sf_dir):
    """The table store's listing: the 40 latest, and of these those that are no side channel."""
    store = TableStore(spark, "unused", F.lit("2024-01-05 00:00:00").cast("timestamp"))
    return store._listed(event_memories(spark, sf_dir), MemoryQuery(namespace="ns2", limit=40)).select("id", "memory_type")


_LINE_META = "CASE WHEN user_id % 5 = 0 THEN lower(hex('side_channel')) || '=' || lower(hex('x')) || ';' ELSE '' END || lower(hex('user')) || '=' || lower(hex(CAST(user_id AS VARCHAR)))"
_ESC = r"replace(replace(replace(replace(replace(replace({0}, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r'), '=', '\e'), ';', '\s')"


@query(f"""WITH m AS ({_MEM}), f AS (SELECT id, concat_ws(chr(9), 'memory', id, namespace, memory_type, {_ESC.format('content')}, {_ESC.format("coalesce(source_event_id, '')")}, printf('%.6f', least(value / 100, 1.0)::DOUBLE), '0.500000', {_ESC.format(_LINE_META)},
CAST(epoch(ts) AS BIGINT), CAST(epoch(ts) AS BIGINT), CAST(epoch(ts) AS BIGINT), CAST(epoch(ts + INTERVAL 5 DAY) AS BIGINT), CASE WHEN value < 10 THEN CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR) ELSE '' END, '') AS line FROM m)
SELECT id, md5(line) AS line_md5, true AS same FROM f""")
def log_round_trip(spark, sf_dir):
    """Every memory as a record's line, read back, and whether that gives the same memory."""
    m = event_memories(spark, sf_dir)
    lines = m.select("id", log.encode_memory().alias("line"))
    back = log.parse(lines.select(F.struct(F.lit(0).cast("long").alias("batch"), F.lit("").alias("file"), F.lit(0).cast("long").alias("start"), F.col("id")).alias("seq"), "line")).filter("error is null").select("f.*")
    rounded = m.withColumns({"importance": F.round("importance", 6)}).select("id", F.struct(*[F.col(c) if c != "metadata" else F.array_sort(F.map_entries(c)) for c in log.MEMORY_FIELDS[1:]]).alias("a"))
    read = back.withColumn("importance", F.round("importance", 6)).select("id", F.struct(*[F.col(c) if c != "metadata" else F.array_sort(F.map_entries(c)) for c in log.MEMORY_FIELDS[1:]]).alias("b"))
    same = rounded.join(read, "id", "left").select("id", F.col("a").eqNullSafe(F.col("b")).alias("same"))
    return lines.select("id", F.md5("line").alias("line_md5")).join(same, "id")


_REPLAYED = """WITH r AS (SELECT event_id AS seq, 'u' || user_id AS id, event_type = 'error' AS gone, value, date_trunc('second', ts) AS ts FROM events),
last AS (SELECT id, max(seq) FILTER (NOT gone) AS m, max(seq) FILTER (gone) AS d FROM r GROUP BY id) SELECT last.id, r.value, CASE WHEN d > m THEN CAST(epoch(g.ts) AS BIGINT) END AS deleted_at FROM last JOIN r ON r.seq = m LEFT JOIN r g ON g.seq = d"""


@query(_REPLAYED)
def log_replay_deletes(spark, sf_dir):
    """Events as records of a log, errors as deletes: the last version of every memory and when it was deleted."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    id_ = F.concat(F.lit("u"), "user_id")
    number = F.format_string("%.6f", F.col("value"))
    time = log.seconds(F.col("ts"))
    memory = log.line("memory", id_, F.lit("default"), F.lit("episodic"), F.col("props"), F.lit(""), number, F.lit("0.5"), F.lit(""), time, time, F.lit(""), F.lit(""), F.lit(""), F.lit(""))
    lines = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", log.encode_delete(id_, F.col("ts"))).otherwise(memory).alias("line"))
    return log.replay_memories(log.parse(lines)).select("id", F.col("importance").alias("value"), F.unix_seconds("deleted_at").alias("deleted_at"))


@query(_REPLAYED)
def snapshot_replay(spark, sf_dir):
    """The same through a store of snapshots: events in ten writes in their order, of puts and deletes, compacted half way."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    bounds = e.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    id_ = F.concat(F.lit("u"), "user_id")
    with Scratch(spark) as scratch:
        store = SnapshotStore(spark, scratch.path("store"), buckets=16)
        width = (bounds.b - bounds.a) // 10 + 1
        for k in range(10):
            part = e.filter(F.col("event_id").between(bounds.a + k * width, bounds.a + (k + 1) * width - 1))
            # within a write a delete after an id's last put is one, other deletes are undone by it
            last = part.groupBy(id_.alias("id")).agg(F.max_by(F.struct("ts", "value", "props"), F.when(F.col("event_type") != "error", F.col("event_id"))).alias("m"), F.max(F.when(F.col("event_type") != "error", F.col("event_id"))).alias("put"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("gone"), F.max_by("ts", F.when(F.col("event_type") == "error", F.col("event_id"))).alias("at"))
            last = scratch.table(last, "last")
            store._append("memory", schema.memories(last.filter("put is not null").selectExpr("id", "m.props content", "m.value importance", "m.ts created_at", "m.ts updated_at")).withColumn("importance", F.lit(0.5)).join(last.selectExpr("id", "m.value held"), "id").withColumn("metadata", F.create_map(F.lit("value"), F.format_string("%.6f", "held"))))
            store._append("delete", last.filter("gone is not null and (put is null or gone > put)").selectExpr("id", "at created_at"))
            if k == 5:
                store.compact()
        return materialize(store.memories().select("id", F.col("metadata")["value"].cast("double").alias("value"), F.unix_seconds("deleted_at").alias("deleted_at")), "replayed")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def props_json_fields(spark, sf_dir):
    """A field of JSON as text."""
    return table(spark, sf_dir, "events").select("event_id", F.get(datasets.json_texts(F.get_json_object("props", "$.k")), F.lit(0)).alias("k"))


# ---- ingest


@query("""SELECT conv_id, turn, role || ' said: ' || CASE WHEN strlen(t) > 240 THEN left(t, 240) || '...' ELSE t END AS told FROM (SELECT conv_id, turn, role, replace(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS t FROM conversations)""")
def episode_summary(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", summary(F.col("role"), F.col("text")).alias("told"))


def dataset_turns(spark, sf_dir) -> DataFrame:
    """Conversations as a dataset's turns; every third has a time, which is that of a session."""
    c = table(spark, sf_dir, "conversations")
    time = F.when(F.col("conv_id") % 3 == 0, F.concat((F.col("turn") % 2 + 1).cast("string"), F.lit(" May 2023")))
    return c.select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").cast("int").alias("turn_index"), F.concat("conv_id", F.lit("::"), "turn").alias("id"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"), time.alias("timestamp"))


_DT = "SELECT CAST(conv_id AS VARCHAR) AS c, turn, conv_id || '::' || turn AS id, role, coalesce(text, '') AS text, CASE WHEN conv_id % 3 = 0 THEN (turn % 2 + 1) || ' May 2023' END AS time FROM conversations"


@query(f"""WITH t AS ({_DT}) SELECT c AS namespace, id AS source_event_id, md5(CASE WHEN time IS NULL THEN '' ELSE '[verbatim_turn time=' || time || '] ' END || role || ': ' || text) AS content_md5, 0.45::DOUBLE AS importance, time AS event_time FROM t
UNION ALL SELECT c, id, md5(text), 0.5::DOUBLE, time FROM t""")
def verbatim_turns(spark, sf_dir):
    m = ingest.verbatim_turns(dataset_turns(spark, sf_dir))
    return m.select("namespace", "source_event_id", F.md5("content").alias("content_md5"), "importance", F.col("metadata")["event_time"].alias("event_time"))


_SESSIONS = f"""WITH t AS ({_DT}), k AS (SELECT *, coalesce('time:' || time, 'conversation') AS key FROM t), g AS (SELECT c, key, count(*) AS n, string_agg(role || ': ' || text || chr(10), '' ORDER BY turn) AS body, string_agg(id, chr(10) ORDER BY turn) AS ids, min_by(id, turn) AS first, max(time) AS time FROM k GROUP BY c, key),
w AS (SELECT c, 'conversation' AS key, count(*) AS n, string_agg(role || ': ' || text || chr(10), '' ORDER BY turn) AS body, string_agg(id, chr(10) ORDER BY turn) AS ids, min_by(id, turn) AS first, min_by(time, turn) AS time FROM k WHERE c IN (SELECT c FROM g GROUP BY c HAVING max(n) < 2 AND sum(n) > 1) GROUP BY c),
s AS (SELECT * FROM g WHERE n >= 2 UNION ALL SELECT * FROM w)"""


@query(f"{_SESSIONS} SELECT c AS namespace, key AS session_key, first AS source_event_id, md5('[verbatim_session' || coalesce(' time=' || time, '') || ']' || chr(10) || body) AS content_md5, md5(ids) AS ids_md5 FROM s")
def verbatim_sessions(spark, sf_dir):
    """Transcripts of sessions, and of conversations that have none."""
    m = ingest.verbatim_sessions(dataset_turns(spark, sf_dir))
    return m.select("namespace", F.col("metadata")["session_key"].alias("session_key"), "source_event_id", F.md5("content").alias("content_md5"), F.md5(F.col("metadata")["source_turn_ids"]).alias("ids_md5"))


@query()
def observations(spark, sf_dir):
    """Observations of all sentences; the rules have no SQL form."""
    found = observe.observations(turns(spark, sf_dir))
    return found.select("namespace", "event_id", "pos", "kind", "subject", "relation", "object", F.array_join("entities", " ").alias("entities"))


@query()
def ingest_dataset(spark, sf_dir):
    """The merged memories of all conversations, with all their forms; the ordered merge has no SQL form."""
    m = ingest.ingest_dataset(dataset_turns(spark, sf_dir))
    return m.select("id", "namespace", "memory_type", F.md5("content").alias("content_md5"), "source_event_id", "importance", "confidence", F.col("metadata")["memory_kind"].alias("memory_kind"), "merged")


@query("""WITH v AS (SELECT 'u' || user_id AS id, ts, max(event_id) AS version, arg_max(value, event_id) AS value, arg_max(event_type = 'error', event_id) AS gone FROM events WHERE event_type <> 'click' GROUP BY user_id, ts),
q AS (SELECT event_id AS query_id, 'u' || user_id AS id, ts FROM events WHERE event_type = 'click')
SELECT query_id, q.id, v.version, CASE WHEN NOT gone AND v.ts + INTERVAL 2 DAYS >= q.ts THEN value END AS value FROM q ASOF LEFT JOIN v ON q.id = v.id AND q.ts >= v.ts""")
def memories_as_of(spark, sf_dir):
    """Clicks as questions, answered from the memory's version at their time; a version is valid for two days, errors delete."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "concat('u', user_id) id", "cast(ts as timestamp) ts", "event_type", "value")
    versions = e.filter("event_type <> 'click'").selectExpr("id", "event_id version", "ts since", "value", "ts valid_from", "ts + interval 2 days valid_to", "case when event_type = 'error' then ts end deleted_at")
    found = asof.as_of(e.filter("event_type = 'click'").selectExpr("event_id query_id", "id", "ts"), versions, ["id"], "ts", "since", "version")
    return found.select("query_id", "id", F.col("version.version").alias("version"), F.when(asof.valid(F.col("version"), F.col("ts")), F.col("version.value")).alias("value"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT CAST(user_id AS VARCHAR) AS namespace, CAST(min(ts) AS TIMESTAMP) AS started, CAST(max(ts) + INTERVAL 6 HOURS AS TIMESTAMP) AS ended, count(*) AS n_turns, string_agg(event_type || ': ' || event_id, chr(10) ORDER BY ts, event_id) AS transcript FROM s GROUP BY user_id, k""")
def gap_sessions(spark, sf_dir):
    """Sessions of all users' events, six hours apart; the plan of the stream on a table."""
    e = table(spark, sf_dir, "events").selectExpr("cast(user_id as string) namespace", "cast(ts as timestamp) time", "event_id seq", "event_type actor", "cast(event_id as string) text")
    return keyed.gap_sessions(e, "6 hours")


# ---- vectors


@query(f"{_ALL.rsplit(', pairs AS', 1)[0].rsplit('shared_e AS', 1)[0].rstrip().rstrip(',')} SELECT query_id, id, round(cosine, 6) AS cosine, rank FROM (SELECT *, CAST({_R.format('round(cosine, 6)')} AS INTEGER) AS rank FROM cosine) WHERE rank <= 5")
def embedding_topk(spark, sf_dir):
    """The nearest documents of every item by hashed embeddings."""
    found = search.search(memories(spark, sf_dir), asked(spark, sf_dir), search.Search(limit=5, weights={"cosine": 1.0}, per_source=None))
    return found.filter("cosine <> 0").select("query_id", "id", F.col("score").alias("cosine"), "rank")


# ---- judges, metrics, answers


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS g FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT *, contains(strftime(g, '%-d %B %Y'), strftime(a, '%-d %B %Y')) OR (l_linenumber % 4 = 0 AND contains(strftime(a, '%-d %B %Y'), strftime(g, '%-d %B %Y'))) AS held, l_linenumber % 4 AS form, g - CAST((isodow(g) - 5 + 7) % 7 AS INTEGER) AS friday, CAST(date_trunc('week', g) AS DATE) AS monday FROM p)
SELECT l_orderkey, l_linenumber, CASE WHEN held THEN true WHEN month(a) = 8 OR month(g) = 8 THEN false ELSE CASE form WHEN 0 THEN abs(a - g) <= 2 WHEN 1 THEN abs(a - g) <= 2 OR a BETWEEN monday AND monday + 6 WHEN 2 THEN abs(a - g) <= 2 OR a BETWEEN monday - 7 AND monday - 1 ELSE abs(a - g) <= 2 OR abs(a - friday) <= 2 END END AS correct FROM r""")
def judge_dates(spark, sf_dir):
    """Order dates as answers, receipt dates as gold answers in four forms; the judge reads no August, as its forms end in st."""
    p = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.to_date("o_orderdate").alias("a"), F.to_date("l_shipdate").alias("g"))
    shown, form = D.shown_column(F.col("g")), F.col("l_linenumber") % 4
    gold = F.when(form == 0, shown).when(form == 1, F.concat(F.lit("Week of "), shown)).when(form == 2, F.concat(F.lit("the week before "), shown)).otherwise(F.concat(F.lit("Friday before "), shown))
    return p.select("l_orderkey", "l_linenumber", evaluate.lenient_judge(D.shown_column(F.col("a")), F.array(gold)).alias("correct"))


@query(f"""{_EVIDENCE}, r AS (SELECT *, CASE WHEN n > 0 THEN 'found' ELSE 'none' END AS category, CASE query_id % 3 WHEN 1 THEN true WHEN 2 THEN false END AS correct FROM per)
SELECT category, count(*) AS questions, count(correct) AS answered, {', '.join(f'round(avg({c}), 5) AS {c}' for c in _NAMES)}, round(avg(correct::INT), 5) AS accuracy, round(avg((recall_10 = 0)::INT), 5) AS miss_10,
round(avg(coalesce(recall_10 > 0 AND NOT correct, false)::INT), 5) AS wrong_with_evidence, round(avg(coalesce(recall_1 > 0 AND NOT correct, false)::INT), 5) AS wrong_with_first FROM r GROUP BY category""")
def summary_by_category(spark, sf_dir):
    """The summary of the items' metrics, apart for items with evidence and without; two thirds count as answered."""
    m = evaluate.metrics(evaluated(spark, sf_dir).withColumn("category", F.when(F.size("evidence") > 0, "found").otherwise("none")), keep=("category",))
    out = evaluate.summarize(m.withColumn("correct", F.when(F.col("query_id") % 3 == 0, F.lit(None)).otherwise(F.col("query_id") % 3 == 1)), ("category",))
    return out.select("category", "questions", "answered", *[F.round(c, 5).alias(c) for c in (*_NAMES, "accuracy", "miss_10", "wrong_with_evidence", "wrong_with_first")])


@query(f"""{_BM}, b8 AS (SELECT * FROM (SELECT *, {_R.format('round(bm25, 6)')} AS rank FROM s) WHERE rank <= 8), sen AS (SELECT query_id, rank, unnest(x) AS sentence, generate_subscripts(x, 1) AS pos FROM (SELECT query_id, rank, {SENT.format('text')} AS x FROM b8 JOIN documents ON doc_id = id)),
words AS (SELECT query_id, rank, pos, list(DISTINCT stem) AS held FROM (SELECT query_id, rank, pos, unnest({TOK.format('sentence')}) AS word FROM sen) JOIN st USING (word) GROUP BY ALL), qb AS (SELECT id AS query_id, list(term) AS q FROM tok WHERE kind = 'q' GROUP BY id),
scored AS (SELECT sen.query_id, sentence, rank, pos, coalesce(len(list_filter(q, lambda t: list_contains(held, t))), 0) AS score FROM sen LEFT JOIN words USING (query_id, rank, pos) LEFT JOIN qb USING (query_id))
SELECT query_id, trim(regexp_replace(regexp_replace(sentence, '\\s+', ' ', 'g'), '^[:,.-]+|[:,.-]+$', '', 'g')) AS answer FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos) = 1""")
def answer_best_sentence(spark, sf_dir):
    """The basic answerer over the eight best documents of every item."""
    return answer.answered(item_evidence(spark, sf_dir), "basic").select("query_id", "answer")


def item_evidence(spark, sf_dir) -> DataFrame:
    plan = search.Search(limit=8, weights=search.BM25_ONLY, per_source=None, matches_only=True)
    found = search.search(memories(spark, sf_dir), asked(spark, sf_dir), plan).select("query_id", "id", "score", "rank").withColumn("reasons", F.array().cast("array<string>"))
    found = materialize(found, "hits")  # a few rows of known size, so that no text is shuffled to them
    stored = memories(spark, sf_dir).select("id", F.coalesce("content", F.lit("")).alias("content"), F.lit("episodic").alias("memory_type"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(0.5).alias("importance"), F.col("source").alias("source_event_id"))
    return asked(spark, sf_dir).join(evidence.candidates(found, stored), "query_id").withColumnRenamed("candidates", "evidence")


@query()
def answer_spans(spark, sf_dir):
    """The span and composing answerers over the same evidence; they have no SQL form."""
    rows = materialize(item_evidence(spark, sf_dir), "evidence")  # searched once for both
    spans = answer.answered(rows, "span").select("query_id", F.col("answer").alias("span"))
    return spans.join(answer.answered(rows, "composer").select("query_id", F.col("answer").alias("composed")), "query_id")


@query(f"""{_SESSIONS}, q AS (SELECT c, turn, id FROM t WHERE turn % 3 = 0), n AS (SELECT q.c, q.turn AS asked, t.turn, t.id, abs(t.turn - q.turn) AS d, t.role, t.text, t.time FROM q JOIN t ON t.c = q.c AND t.turn BETWEEN q.turn - 1 AND q.turn + 1)
SELECT c || '::' || asked AS query_id, id AS source_event_id, md5('[source_window distance=' || d || coalesce(' time=' || time, '') || '] ' || role || ': ' || text) AS content_md5, round(0.3 / greatest(d, 1), 6) AS score FROM n""")
def source_window_evidence(spark, sf_dir):
    """Turns beside every third turn, as evidence."""
    t = dataset_turns(spark, sf_dir)
    near = t.filter("turn_index % 3 = 0").select(F.concat("conversation_id", F.lit("::"), "turn_index").alias("query_id"), F.col("conversation_id").alias("namespace"), F.col("id").alias("source"), F.lit(0).alias("at"))
    p = evidence.window_packets(near, t)
    return p.select("query_id", "p.source_event_id", F.md5("p.content").alias("content_md5"), F.round("p.score", 6).alias("score"))


@query()
def conversation_evidence(spark, sf_dir):
    """All evidence of every conversation's first turn as a question: hits, turns, neighbours, sessions, observations."""
    t = dataset_turns(spark, sf_dir)
    q = t.filter("turn_index = 0").select(F.col("conversation_id").alias("query_id"), "conversation_id", "text")
    with Scratch(spark) as scratch:
        # they are read six times
        stored = scratch.table(ingest.dataset_memories(t).drop("seq"), "stored")
        seen = log.visible(stored, side_channel=False)
        found = search.search(seen, q.select("query_id", F.col("conversation_id").alias("namespace"), "text"), search.Search(limit=50)).withColumn("reasons", search.reasons())
        out = evidence.evidence(q, evidence.candidates(found, stored), stored, t, evidence.Pack("two-stage", 10))
        return materialize(out.select("query_id", F.posexplode("evidence").alias("pos", "p")).select("query_id", "pos", "p.source_event_id", F.md5("p.content").alias("content_md5"), F.round("p.score", 4).alias("score")), "evidence")
