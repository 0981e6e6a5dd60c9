"""Queries over the driver's tables that apply the library's operators, and DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.functions import normal as N
from recallforge.functions import stem
from recallforge.functions import text as T
from recallforge.operators import evaluate, ingest
from recallforge.plans.registry import ORACLES, QUERIES, SENT, TOK, query, table, turns
from recallforge.plans.stem_sql import stems
from recallforge.sources import log

from recallforge.plans import memory, retrieval  # noqa: F401  (they register their queries)

__all__ = ["ORACLES", "QUERIES"]


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)")
def tokenize_stats(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("t"))
    return t.selectExpr("doc_id", "cast(size(t) as long) n_tokens", "cast(size(array_distinct(t)) as long) n_distinct")


@query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(length(array_to_string(s, '')) AS BIGINT) AS n_chars FROM (SELECT doc_id, {SENT.format('text')} AS s FROM documents)")
def sentence_split(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.selectExpr("doc_id", "cast(size(s) as long) n_sentences", "cast(length(array_join(s, '')) as long) n_chars")


_RULE_SQL = " ".join(f"WHEN {' OR '.join(f'contains(l, $${p}$$)' for p in phrases)} THEN '{kind}|{i}|{c}'" for kind, i, c, phrases in T.RULES)


@query(f"""SELECT conv_id, turn, pos, split_part(r, '|', 1) AS memory_type, CAST(split_part(r, '|', 2) AS DOUBLE) AS importance, CAST(split_part(r, '|', 3) AS DOUBLE) AS confidence, strlen(lower(x)) >= 12 AS keep
FROM (SELECT *, CASE {_RULE_SQL.replace('(l,', '(lower(x),')} ELSE 'episodic|0.45|0.58' END AS r FROM (SELECT conv_id, turn, unnest({SENT.format('text')}) AS x, CAST(generate_subscripts({SENT.format('text')}, 1) - 1 AS INTEGER) AS pos FROM conversations))""")
def classify_rules(spark, sf_dir):
    """The rules over all sentences of all turns."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("pos", "x"))
    c = rows.withColumn("c", T.classify(F.lower("x")))
    return c.select("conv_id", "turn", "pos", "c.*", T.should_keep(F.lower("x"), F.col("c.memory_type")).alias("keep"))


_CAND = f"""WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS namespace, conv_id || '::' || turn AS event_id, unnest({SENT.format('text')}) AS content, generate_subscripts({SENT.format('text')}, 1) - 1 AS pos FROM conversations),
k AS (SELECT *, CASE {_RULE_SQL.replace('(l,', '(lower(content),')} ELSE 'episodic|0.45|0.58' END AS r FROM s WHERE strlen(lower(content)) >= 12),
told AS (SELECT CAST(conv_id AS VARCHAR), conv_id || '::' || turn, 0, role || ' said: ' || CASE WHEN strlen(t) > 240 THEN left(t, 240) || '...' ELSE t END, 'episodic', 0.35::DOUBLE, 0.55::DOUBLE FROM (SELECT *, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS t FROM conversations) WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) >= 8 AND conv_id || '::' || turn NOT IN (SELECT event_id FROM k)),
c AS (SELECT namespace, event_id, CAST(pos AS INTEGER) AS pos, content, split_part(r, '|', 1) AS memory_type, CAST(split_part(r, '|', 2) AS DOUBLE) AS importance, CAST(split_part(r, '|', 3) AS DOUBLE) AS confidence FROM k QUALIFY row_number() OVER (PARTITION BY event_id, lower(content) ORDER BY pos) = 1 UNION ALL SELECT * FROM told)"""


@query(f"{_CAND} SELECT * FROM c")
def extract_memories(spark, sf_dir):
    return ingest.candidates(turns(spark, sf_dir))


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents WHERE lang = 'en' GROUP BY source")
def namespace_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("lang", "namespace")
    return log.visible(d, "en").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


_EVENTS = "SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS id, event_type AS memory_type, value FROM events"


def records(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id seq", "cast(user_id as string) id", "event_type memory_type", "value", "cast(ts as timestamp) ts", "props")


@query(f"SELECT id, seq, memory_type, value FROM ({_EVENTS}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1")
def log_replay_lww(spark, sf_dir):
    return log.latest(records(spark, sf_dir).select("id", "seq", "memory_type", "value"), "id", "seq")


@query("SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 16")
def list_recent_limit(spark, sf_dir):
    return records(spark, sf_dir).orderBy(F.desc("ts"), F.desc("seq")).limit(16).select("seq", "id")


@query("""WITH v AS (SELECT event_id, event_type, ts AS valid_from, ts + INTERVAL 3 DAY AS valid_to, CASE WHEN value < 10 THEN ts END AS deleted_at FROM events), m AS (SELECT max(ts) - INTERVAL 5 DAY AS t FROM events)
SELECT event_type AS memory_type, count(*) AS n FROM v, m WHERE deleted_at IS NULL AND valid_from <= t AND valid_to >= t GROUP BY event_type""")
def validity_and_soft_delete(spark, sf_dir):
    r = records(spark, sf_dir)
    now = r.agg((F.max("ts") - F.expr("interval 5 days")).alias("now"))  # one row
    rows = r.crossJoin(F.broadcast(now)).withColumns({"valid_from": F.col("ts"), "valid_to": F.col("ts") + F.expr("interval 3 days"), "deleted_at": F.when(F.col("value") < 10, F.col("ts"))})
    return log.visible(rows, as_of=F.col("now")).groupBy("memory_type").agg(F.count("*").alias("n"))


@query("SELECT event_id AS seq, lower(hex(event_type)) || '=' || lower(hex(CAST(user_id AS VARCHAR))) AS metadata FROM events")
def metadata_hex(spark, sf_dir):
    return records(spark, sf_dir).select("seq", T.hex_pairs(F.create_map("memory_type", "id")).alias("metadata"))


@query(r"SELECT doc_id, replace(replace(replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r'), '=', '\e'), ';', '\s') AS line FROM documents")
def log_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", log.escape(F.col("text")).alias("line"))


@query("SELECT lower(text) AS content, min(doc_id) AS id, count(*) AS merged, max(n_chars) AS importance FROM documents GROUP BY lower(text)")
def merge_metadata_max(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.lower("text").alias("content")).agg(F.min("doc_id").alias("id"), F.count("*").alias("merged"), F.max("n_chars").alias("importance"))


@query("""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS namespace, turn AS seq, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
m AS (SELECT *, CASE WHEN n < 5 THEN 0 ELSE CAST(floor((n - 5) / 3) AS BIGINT) + 1 END AS m FROM t), w AS (SELECT *, unnest(range(0, m + 1)) AS j FROM m)
SELECT namespace, j AS "window", j < max(m) AS "full", count(*) AS n_turns, '[Multi-turn conversation — ' || count(*) || ' turns]' || chr(10) || string_agg('Turn ' || (i - j * 3 + 1) || ' — ' || role || ': ' || text, chr(10) ORDER BY i) AS combined
FROM w WHERE i >= j * 3 AND (j = m OR i < j * 3 + 5) GROUP BY namespace, j""")
def window_combine(spark, sf_dir):
    return ingest.windows(turns(spark, sf_dir), 5)


@query("SELECT CAST(conv_id AS VARCHAR) AS namespace, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id HAVING count(*) >= 2")
def session_transcript(spark, sf_dir):
    return ingest.transcripts(turns(spark, sf_dir))


@query("SELECT CAST(a.conv_id AS VARCHAR) AS namespace, a.turn AS seq, b.turn AS near, abs(b.turn - a.turn) AS distance, 0.3 / greatest(abs(b.turn - a.turn), 1) AS score FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1")
def source_window_neighbors(spark, sf_dir):
    return ingest.neighbours(turns(spark, sf_dir)).withColumn("score", F.col("score").cast("double"))


def _fold_sql(namespace: str, seq: str) -> str:
    """The merge on write row by row, as a recursion over a list of memories: the first one that matches takes a row up."""
    low = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    stemmed = f"word AS (SELECT DISTINCT unnest({TOK.format('content')}) AS word FROM c), {stems('SELECT word FROM word')}"
    return f"""{_CAND.replace('WITH s AS', 'WITH RECURSIVE s AS', 1)}, {stemmed},
bag AS (SELECT event_id, pos, content, list(DISTINCT stem) AS toks FROM (SELECT event_id, pos, content, unnest({TOK.format('content')}) AS word FROM c) JOIN st USING (word) GROUP BY ALL),
r AS (SELECT {namespace} AS namespace, memory_type, {seq} AS seq, content, importance, confidence, coalesce(toks, CAST([] AS VARCHAR[])) AS toks, row_number() OVER (PARTITION BY {namespace}, memory_type ORDER BY {seq}, content) AS i FROM c LEFT JOIN bag USING (event_id, pos, content)),
n AS (SELECT namespace, memory_type, max(i) AS n FROM r GROUP BY ALL),
fold(namespace, memory_type, i, pool) AS (SELECT namespace, memory_type, 0::BIGINT, CAST([] AS STRUCT(content VARCHAR, importance DOUBLE, confidence DOUBLE, seq BIGINT, merged BIGINT, toks VARCHAR[])[]) FROM n
UNION ALL SELECT f.namespace, f.memory_type, f.i, CASE WHEN place = 0 THEN list_append(pool, struct_pack(content := f.content, importance := f.importance, confidence := f.confidence, seq := f.seq, merged := 1::BIGINT, toks := f.toks))
  ELSE list_transform(pool, lambda m, k: CASE WHEN k <> place THEN m ELSE struct_pack(content := CASE WHEN contains(m.content, f.content) THEN m.content WHEN contains(f.content, m.content) THEN f.content ELSE m.content || '; ' || f.content END,
    importance := greatest(m.importance, f.importance), confidence := greatest(m.confidence, f.confidence), seq := m.seq, merged := m.merged + 1, toks := CASE WHEN contains(m.content, f.content) THEN m.toks WHEN contains(f.content, m.content) THEN f.toks ELSE list_distinct(m.toks || f.toks) END) END) END
  FROM (SELECT r.*, fold.pool, coalesce(list_position(list_transform(fold.pool, lambda m: {low.format('m.content')} = {low.format('r.content')} OR (len(m.toks) > 0 AND len(r.toks) > 0 AND len(list_intersect(m.toks, r.toks)) >= {ingest.SAME}::DOUBLE * len(list_distinct(m.toks || r.toks)))), true), 0) AS place FROM fold JOIN r ON r.namespace = fold.namespace AND r.memory_type = fold.memory_type AND r.i = fold.i + 1) AS f)
SELECT namespace, memory_type, m.content AS content, m.importance AS importance, m.confidence AS confidence, m.seq AS seq, m.merged AS merged FROM (SELECT namespace, memory_type, unnest(pool) AS m FROM fold JOIN n USING (namespace, memory_type) WHERE fold.i = n.n)"""


_FOLD = ("namespace", "memory_type", "content", "importance", "confidence", "seq", "merged")


@query(_fold_sql("namespace", "CAST(split_part(event_id, '::', 2) AS BIGINT) * 1000000 + pos"))
def remember_fold(spark, sf_dir):
    """The memories of every conversation, merged on write in the order of the turns."""
    c = ingest.candidates(turns(spark, sf_dir))
    return ingest.fold(c.selectExpr("namespace", "memory_type", "cast(split(event_id, '::')[1] as long) * 1000000 + pos seq", "content", "importance", "confidence")).select(*_FOLD)


@query()
def remember_fold_one_namespace(spark, sf_dir):
    """All conversations as one namespace: the order holds among memories that can meet, which are replayed in parallel.

    The SQL of ``remember_fold`` gives the same rows here, but as one list of memories it takes minutes, so it isn't registered.
    """
    c = ingest.candidates(turns(spark, sf_dir)).selectExpr("'default' namespace", "memory_type", "cast(split(event_id, '::')[0] as long) * 1000000000 + cast(split(event_id, '::')[1] as long) * 1000000 + pos seq", "content", "importance", "confidence")
    return ingest.fold(c).select(*_FOLD)


_SQUEEZE = "trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g'))"


@query(f"""SELECT conv_id, turn, n <> '' AND len(list_filter([g], lambda x: x <> '' AND (contains(n, x) OR contains(x, n)))) > 0 AS correct FROM (
SELECT a.conv_id, a.turn, {_SQUEEZE.format('b.text')} AS n, {_SQUEEZE.format('a.text')} AS g FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""")
def judge_exact(spark, sf_dir):
    """The judge over all neighbouring turns: the later one as answer, the earlier one as gold."""
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", evaluate.exact_judge(F.coalesce("held", F.lit("")), F.array(F.coalesce("text", F.lit("")))).alias("correct"))


@query("SELECT o_orderkey, CAST(isodow(o_orderdate) AS INTEGER) AS weekday, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday, strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d') AS sunday, strftime(o_orderdate, '%-d %B %Y') AS shown FROM orders")
def date_arith(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return o.selectExpr("o_orderkey", "cast(weekday(d) + 1 as int) weekday", "date_format(date_trunc('week', d), 'yyyy-MM-dd') monday", "date_format(date_add(to_date(date_trunc('week', d)), 6), 'yyyy-MM-dd') sunday", "date_format(d, 'd MMMM yyyy') shown")


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (l.doc_id IS NOT NULL) AS labelled, CAST(coalesce(sum(quality), 0) AS BIGINT) AS good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ROLLUP (lang, source)")
def report_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").withColumn("l", F.lit(1)), "doc_id", "left")
    return d.rollup("lang", "source").agg(F.count("*").alias("n"), F.count("l").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("good"))


@query("SELECT (SELECT count(*) FROM documents SEMI JOIN labels USING (doc_id)) AS with_label, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS without_label")
def evidence_semi_anti(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    a = d.join(lab, "doc_id", "left_semi").agg(F.count("*").alias("with_label"))
    return a.crossJoin(d.join(lab, "doc_id", "left_anti").agg(F.count("*").alias("without_label")))  # one row each


_NUMBER_SQL = " ".join(f"WHEN '{word}' THEN '{i}'" for i, word in enumerate(N.NUMBERS))


@query(f"""SELECT doc_id, md5(v) AS normal_md5, CAST(length(v) AS BIGINT) AS n_chars FROM (SELECT doc_id, array_to_string(list_transform(
list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the')),
lambda w: CASE regexp_replace(w, '{N.ORDINAL}', '') {_NUMBER_SQL} ELSE regexp_replace(w, '{N.ORDINAL}', '') END), ' ') AS v FROM documents)""")
def lenient_normal_form(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select("doc_id", N.lenient(F.col("text")).alias("v"))
    return v.select("doc_id", F.md5("v").alias("normal_md5"), F.length("v").cast("long").alias("n_chars"))


@query(r"""SELECT source, CAST(CAST(list_filter(string_split(source, '_'), lambda p: regexp_matches(p, '^\+?[0-9]+$'))[-1] AS BIGINT) AS BIGINT) AS turn_index
FROM (SELECT conv_id || '_turn_' || turn || CASE WHEN role = 'user' THEN '_u' ELSE '' END AS source FROM conversations)""")
def turn_index_of_source(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").selectExpr("concat(conv_id, '_turn_', turn, case when role = 'user' then '_u' else '' end) source")
    return c.select("source", N.turn_index(F.col("source")).alias("turn_index"))


_TURN_PAIRS = "FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def turn_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    following = c.selectExpr("conv_id", "turn - 1 turn", "role held_role", "text held")
    return c.join(following, ["conv_id", "turn"])


@query(f"""SELECT conv_id, turn, CASE WHEN len(q) = 0 THEN 0.0 ELSE list_sum(list_transform(q, lambda x: coalesce(list_max(list_transform(m, lambda y: CASE WHEN x = y THEN 1.0::DOUBLE WHEN strlen(x) >= 4 AND strlen(y) >= 4 AND (starts_with(x, y) OR starts_with(y, x)) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)), 0.0))) / len(q) END AS prefix_bonus,
CAST(least(0.5 * len(list_intersect(list_distinct(q), list_distinct(m))), 1.2) AS DOUBLE) AS entity_boost
FROM (SELECT a.conv_id, a.turn, {TOK.format('a.text')} AS q, {TOK.format('b.text')} AS m {_TURN_PAIRS})""")
def prefix_and_shared_signals(spark, sf_dir):
    p = turn_pairs(spark, sf_dir).select("conv_id", "turn", T.tokens("text").alias("q"), T.tokens("held").alias("m"))
    return p.select("conv_id", "turn", N.prefix_bonus(F.col("q"), F.col("m")).alias("prefix_bonus"), N.entity_boost(F.col("q"), F.col("m")).cast("double").alias("entity_boost"))


@query(f"""SELECT a.conv_id, a.turn, CASE WHEN contains(lower(coalesce(a.text, '')), lower(b.role)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS speaker_match,
CASE WHEN b.role = 'user' THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END AS kind_factor {_TURN_PAIRS}""")
def speaker_and_kind_signals(spark, sf_dir):
    kind = F.when(F.col("held_role") == "user", "verbatim_turn").otherwise("other")
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", N.speaker_match(F.col("text"), F.col("held_role")).alias("speaker_match"), N.kind_factor(kind).cast("double").alias("kind_factor"))


@query(f"""WITH raw AS (SELECT unnest({TOK.format('text')}) AS word FROM documents), n AS (SELECT word, count(*) AS n FROM raw GROUP BY word), {stems('SELECT word FROM n')} SELECT stem, count(*) AS n_words, CAST(sum(n) AS BIGINT) AS n_uses FROM n JOIN st USING (word) GROUP BY stem""")
def stem_vocabulary(spark, sf_dir):
    """Stems of all words of the documents with the number of their words and uses."""
    v = stem.vocabulary(table(spark, sf_dir, "documents"), T.tokens("text"))
    return v.groupBy("stem").agg(F.count("*").alias("n_words"), F.sum("n").alias("n_uses"))
