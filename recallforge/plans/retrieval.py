"""Queries of search, context and retrieval metrics; items of ``benchmark`` are the questions, documents the memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.functions import entities as E
from recallforge.operators import evaluate, retrieve, search
from recallforge.plans.registry import TOK, asked, memories, query, table
from recallforge.plans.stem_sql import stems
from recallforge.sources.index import TextIndex
from recallforge.sources.shared import Scratch, materialize

#: Stemmed tokens of documents (kind d) and items (kind q), and BM25 of the pairs that share one.
_TERMS = f"""raw AS MATERIALIZED (SELECT 'd' AS kind, doc_id AS id, lang AS ns, coalesce(text, '') AS text, {TOK.format('text')} AS t FROM documents UNION ALL SELECT 'q', item_id, NULL, coalesce(text, ''), {TOK.format('text')} FROM benchmark),
{stems('SELECT DISTINCT unnest(t) AS word FROM raw')}, tok AS MATERIALIZED (SELECT kind, id, ns, pos, stem AS term FROM (SELECT kind, id, ns, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM raw) JOIN st USING (word))"""
_BM = f"""WITH {_TERMS}, len AS (SELECT id, len(t) AS dl FROM raw WHERE kind = 'd'), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
tf AS (SELECT id, term, count(*) AS tf FROM tok WHERE kind = 'd' GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), qt AS (SELECT DISTINCT id AS query_id, term FROM tok WHERE kind = 'q'),
s AS (SELECT query_id, id, count(*) AS shared, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))) AS bm25 FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN len USING (id), tot GROUP BY query_id, id)"""
_R = "row_number() OVER (PARTITION BY query_id ORDER BY {0} DESC, id)"


@query(f"{_BM} SELECT term, df, n AS doc_count, round(avgdl, 6) AS avg_len FROM df, tot")
def bm25_stats(spark, sf_dir):
    return retrieve.bm25_stats(memories(spark, sf_dir)).withColumn("avg_len", F.round("avg_len", 6))


_BM25 = search.Search(limit=10, weights=search.BM25_ONLY, per_source=None, matches_only=True)


@query(f"{_BM} SELECT query_id, id, round(bm25, 6) AS bm25, rank FROM (SELECT *, CAST({_R.format('round(bm25, 6)')} AS INTEGER) AS rank FROM s) WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    hits = found(memories(spark, sf_dir), asked(spark, sf_dir), _BM25)
    return hits.select("query_id", "id", F.col("score").alias("bm25"), "rank")


def found(memories: DataFrame, queries: DataFrame, plan: search.Search | None = None, prepare=None) -> DataFrame:
    """``search.search`` through an index of the memories, which is made for it and deleted after."""
    with Scratch(memories.sparkSession) as scratch:
        index = TextIndex.build(search.spread(memories), scratch.path("index"))
        return search.search(memories, queries, plan, index, prepare)


#: Entities of texts: (kind, id, e).
_ENTITIES = r"""piece AS (SELECT *, row_number() OVER () AS p FROM (SELECT kind, id, text AS s FROM raw UNION ALL SELECT * FROM (SELECT kind, id, unnest(string_split_regex(text, '[.!?]')) FROM raw))),
quoted AS (SELECT kind, id, trim(v, chr(32) || chr(9) || chr(10) || chr(13)) AS v FROM (SELECT kind, id, unnest(x) AS v, generate_subscripts(x, 1) AS i, len(x) AS n FROM (SELECT kind, id, string_split_regex(s, '["“”]') AS x FROM piece)) WHERE i % 2 = 0 AND i < n),
word AS (SELECT kind, id, p, i, regexp_replace(regexp_replace(w, '^[^A-Za-z0-9]+', ''), '[^A-Za-z0-9]+$', '') AS w FROM (SELECT kind, id, p, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT kind, id, p, list_filter(string_split_regex(s, '\s+'), lambda w: w <> '') AS x FROM piece))),
sorted AS (SELECT *, length(w) > 1 AND regexp_matches(w, '^[A-Z]') AND w NOT IN (COMMON) AS proper, regexp_full_match(w, '[A-Z][a-z]*|[A-Z]{2,}') AND w NOT IN (COMMON) AS title FROM word),
run AS (SELECT kind, id, string_agg(w, ' ' ORDER BY i) AS v, count(*) AS n, kindof FROM (SELECT kind, id, p, i, w, 'p' AS kindof, i - row_number() OVER (PARTITION BY p ORDER BY i) AS g FROM sorted WHERE proper UNION ALL SELECT kind, id, p, i, w, 't', i - row_number() OVER (PARTITION BY p ORDER BY i) FROM sorted WHERE title) GROUP BY kind, id, p, g, kindof),
ent AS MATERIALIZED (SELECT DISTINCT kind, id, lower(v) AS e FROM (SELECT kind, id, v FROM quoted WHERE strlen(v) > 1 AND regexp_matches(v, '[^!-/:-@\[-`{-~]') UNION ALL SELECT kind, id, v FROM run WHERE kindof = 'p' OR n > 1 UNION ALL SELECT kind, id, w FROM sorted WHERE proper))""".replace("COMMON", ", ".join(f"'{w}'" for w in E.COMMON))


@query(f"WITH {_TERMS}, {_ENTITIES} SELECT e AS entity, count(*) AS n, CAST(min(id) AS BIGINT) AS first FROM ent WHERE kind = 'd' GROUP BY e")
def entity_links(spark, sf_dir):
    """The inverted index of all documents' entities."""
    links = E.entity_links(whole_memories(spark, sf_dir))
    return links.groupBy("entity").agg(F.count("*").alias("n"), F.min("id").cast("long").alias("first"))


@query(f"WITH {_TERMS}, {_ENTITIES} SELECT q.id AS query_id, count(DISTINCT d.id) AS n FROM ent q JOIN ent d ON q.e = d.e AND q.kind = 'q' AND d.kind = 'd' GROUP BY q.id")
def linked_memories(spark, sf_dir):
    q = asked(spark, sf_dir).select("query_id", E.entities("text").alias("entities"))
    return E.linked_memories(E.entity_links(whole_memories(spark, sf_dir)), q).groupBy("query_id").agg(F.count("*").alias("n"))


def whole_memories(spark, sf_dir) -> DataFrame:
    """Documents as stored memories, with all that a search looks at; entities are those of the content."""
    return E.enrich(search.spread(plain_memories(spark, sf_dir)))


def plain_memories(spark, sf_dir) -> DataFrame:
    """As ``whole_memories``, without entities."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id id", "'default' namespace", "text content", "concat(source, '_turn_', doc_id % 7) source_event_id", "0.3D + (doc_id % 5) / 10.0D importance",
        "map('speaker', lang, 'memory_kind', case lang when 'en' then 'verbatim_turn' when 'de' then 'observation' when 'fr' then 'llm_fact' else 'other' end) metadata",
    )


#: All signals of all pairs of an item and a document.
_ALL = f"""{_BM}, {_ENTITIES},
emb AS (SELECT kind, id, b, v / sqrt(sum(v * v) OVER (PARTITION BY kind, id)) AS v FROM (SELECT kind, id, h % 128 AS b, sum(1 - 2 * (h % 2)) AS v FROM (SELECT kind, id, CAST('0x' || substr(md5(term), 1, 15) AS BIGINT) AS h FROM tok) GROUP BY kind, id, b)),
cosine AS (SELECT q.id AS query_id, d.id, sum(q.v * d.v) AS cosine FROM emb q JOIN emb d ON q.b = d.b AND q.kind = 'q' AND d.kind = 'd' GROUP BY q.id, d.id),
sizes AS (SELECT kind, id, count(DISTINCT term) AS n FROM tok GROUP BY kind, id),
vq AS (SELECT DISTINCT term FROM qt), vd AS (SELECT DISTINCT term FROM tf),
near AS (SELECT vq.term AS a, vd.term AS b, CASE WHEN vq.term = vd.term THEN 1.0 ELSE 0.5 END AS v FROM vq JOIN vd ON left(vq.term, 2) = left(vd.term, 2) WHERE vq.term = vd.term OR (strlen(vq.term) >= 4 AND strlen(vd.term) >= 4 AND (starts_with(vq.term, vd.term) OR starts_with(vd.term, vq.term)))),
prefix AS (SELECT query_id, id, sum(v) AS prefix FROM (SELECT query_id, id, a, max(v) AS v FROM qt JOIN near ON qt.term = a JOIN tf ON tf.term = b GROUP BY ALL) GROUP BY query_id, id),
shared_e AS (SELECT q.id AS query_id, d.id, least(0.5 * count(*), 1.2) AS entity FROM ent q JOIN ent d ON q.e = d.e AND q.kind = 'q' AND d.kind = 'd' GROUP BY q.id, d.id),
pairs AS (SELECT b.item_id AS query_id, d.doc_id AS id, d.text AS content, source || '_turn_' || doc_id % 7 AS source, round(0.32 * coalesce(shared / nullif(coalesce(zd.n, 0) + coalesce(zq.n, 0) - coalesce(shared, 0), 0), 0) + 0.13 * coalesce(bm25, 0) + 0.15 * coalesce(entity, 0) + 0.05 * CASE WHEN contains(lower(b.text), lang) THEN 1 ELSE 0 END
  + 0.02 * greatest(coalesce(cosine, 0), 0) + 0.25 * coalesce(prefix, 0) / greatest(coalesce(zq.n, 0), 1) + 0.1 * CASE WHEN entity > 0.05 THEN 1.0 / (1 + doc_id % 7) ELSE 0 END + 0.03 * (0.3 + (doc_id % 5) / 10.0) + 0.05 * CASE lang WHEN 'en' THEN 1.2 WHEN 'de' THEN 1.0 WHEN 'fr' THEN 1.1 ELSE 0.8 END, 6) AS score,
  coalesce(cosine, 0) AS cosine, coalesce(bm25, 0) AS bm25, coalesce(shared / nullif(coalesce(zd.n, 0) + coalesce(zq.n, 0) - coalesce(shared, 0), 0), 0) AS density, coalesce(entity, 0) AS entity, contains(lower(b.text), lang) AS speaker
  FROM benchmark b CROSS JOIN documents d LEFT JOIN s ON s.query_id = item_id AND s.id = doc_id LEFT JOIN cosine c ON c.query_id = item_id AND c.id = doc_id LEFT JOIN prefix p ON p.query_id = item_id AND p.id = doc_id LEFT JOIN shared_e e ON e.query_id = item_id AND e.id = doc_id LEFT JOIN sizes zd ON zd.kind = 'd' AND zd.id = doc_id LEFT JOIN sizes zq ON zq.kind = 'q' AND zq.id = item_id),
capped AS (SELECT * FROM pairs QUALIFY source IS NULL OR row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) <= 2),
top AS (SELECT * FROM (SELECT *, CAST({_R.format('score')} AS INTEGER) AS rank FROM capped) WHERE rank <= 8)"""


def hits(spark, sf_dir) -> DataFrame:
    return found(plain_memories(spark, sf_dir), asked(spark, sf_dir), prepare=E.enrich)


@query(f"{_ALL} SELECT query_id, id, source, score, rank FROM top")
def hybrid_topk_source_cap(spark, sf_dir):
    """All signals of the score, two of a source at most."""
    return hits(spark, sf_dir).select("query_id", "id", "source", "score", "rank")


@query(f"""{_ALL}, why AS (SELECT query_id, id, concat_ws(',', CASE WHEN cosine > 0.3 THEN 'semantic_match' WHEN cosine > 0.1 THEN 'weak_semantic_match' END, CASE WHEN bm25 > 0.1 THEN 'keyword_match' WHEN density > 0.1 THEN 'weak_keyword_match' END, CASE WHEN entity > 0.05 THEN 'entity_match' END, CASE WHEN speaker THEN 'speaker_match' END) AS r FROM top)
SELECT query_id, id, CASE WHEN r = '' THEN 'low_relevance' ELSE r END AS reasons FROM why""")
def hit_reasons(spark, sf_dir):
    return hits(spark, sf_dir).select("query_id", "id", F.array_join(search.reasons(), ",").alias("reasons"))


@query(f"""{_ALL} SELECT query_id, '# Agent Memory' || chr(10) || string_agg('- [episodic score=' || format('{{:.3f}}', round(score, 3)) || ' confidence=0.75] ' || coalesce(content, '') || chr(10), '' ORDER BY rank) AS context FROM top GROUP BY query_id""")
def build_context(spark, sf_dir):
    """The context of every item: whole memories and their scores."""
    best = materialize(hits(spark, sf_dir).select("query_id", "id", "rank", "score"), "hits")  # of known size: no text is shuffled to them
    found = best.join(memories(spark, sf_dir).select("id", "content"), "id")
    return retrieve.build_context(found.withColumns({"memory_type": F.lit("episodic"), "confidence": F.lit(0.75)}), asked(spark, sf_dir))


@query(f"{_ALL}, b10 AS (SELECT query_id, id, round(bm25, 6) AS score FROM (SELECT *, {_R.format('round(bm25, 6)')} AS rank FROM s) WHERE rank <= 10), u AS (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score FROM top UNION ALL SELECT query_id, id, score FROM b10) GROUP BY ALL) SELECT query_id, id, score, rank FROM (SELECT *, CAST({_R.format('score')} AS INTEGER) AS rank FROM u) WHERE rank <= 5")
def fuse_candidates(spark, sf_dir):
    """The hybrid and the BM25 list of each item as one, by the better score."""
    b = found(memories(spark, sf_dir), asked(spark, sf_dir), _BM25).select("query_id", "id", "score")
    return retrieve.fuse(hits(spark, sf_dir), b, 5)


@query(f"""WITH {_TERMS}, len AS (SELECT id, ns, len(t) AS dl FROM raw WHERE kind = 'd'), tot AS (SELECT ns, count(*) AS n, avg(dl) AS avgdl FROM len GROUP BY ns), tf AS (SELECT id, ns, term, count(*) AS tf FROM tok WHERE kind = 'd' GROUP BY ALL), df AS (SELECT ns, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT DISTINCT id AS item, term FROM tok WHERE kind = 'q'), s AS (SELECT tf.ns || ':' || item AS query_id, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (ns, term) JOIN len USING (id) JOIN tot ON tot.ns = tf.ns GROUP BY ALL)
SELECT query_id, id, score, rank FROM (SELECT *, CAST({_R.format('score')} AS INTEGER) AS rank FROM s) WHERE rank <= 10""")
def search_by_namespace(spark, sf_dir):
    """Every item asked in every language's namespace, by that namespace's own statistics."""
    spaces = table(spark, sf_dir, "documents").select(F.col("lang").alias("namespace")).distinct()
    q = asked(spark, sf_dir).join(F.broadcast(spaces)).selectExpr("concat(namespace, ':', query_id) query_id", "namespace", "text")  # a few languages
    hits = found(table(spark, sf_dir, "documents").selectExpr("doc_id id", "lang namespace", "text content"), q, _BM25)
    return hits.select("query_id", "id", "score", "rank")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, round(list_dot_product(e::DOUBLE[], embedding::DOUBLE[]), 4) AS score FROM q, embeddings)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""")
def vector_topk(spark, sf_dir):
    """Every vector whose id is divisible by 50, against all."""
    v = table(spark, sf_dir, "embeddings").selectExpr("vec_id id", "embedding e")
    return search.nearest(v, v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), 10)


_EVIDENCE = f"""{_BM}, bag AS (SELECT kind, id, list(term ORDER BY pos) AS t FROM tok GROUP BY kind, id), k AS (SELECT id AS query_id, t, CAST(least(len(t), 8) AS BIGINT) AS n FROM bag WHERE kind = 'q'), g AS (SELECT DISTINCT query_id, array_to_string(t[i:i+n-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS i FROM k)),
dg AS (SELECT DISTINCT id, array_to_string(t[i:i+n-1], ' ') AS g FROM (SELECT id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM bag, (SELECT DISTINCT n FROM k) WHERE kind = 'd' AND len(t) >= n)),
ev AS (SELECT query_id, list(DISTINCT id) AS e FROM g JOIN dg USING (g) GROUP BY query_id), hits AS (SELECT * FROM (SELECT query_id, id, {_R.format('round(bm25, 6)')} AS rank FROM s) WHERE rank <= 10),
j AS (SELECT hits.query_id, rank, coalesce(list_contains(e, id), false) AS hit, coalesce(len(e), 0) AS n FROM hits LEFT JOIN ev USING (query_id)),
per AS (SELECT query_id, max(n) AS n, {', '.join(f'count(*) FILTER (hit AND rank <= {k}) / greatest(max(n), 1) AS recall_{k}' for k in (1, 3, 5, 10))}, coalesce(1.0 / min(rank) FILTER (hit), 0) AS mrr,
coalesce(sum(1.0 / log2(rank + 1)) FILTER (hit AND rank <= 5), 0) / list_sum(list_transform(range(1, greatest(least(max(n), 5), 1) + 1), lambda i: 1.0 / log2(i + 1))) AS ndcg_5 FROM j GROUP BY query_id)"""
_NAMES = [*(f"recall_{k}" for k in (1, 3, 5, 10)), "mrr", "ndcg_5"]


def evaluated(spark, sf_dir) -> DataFrame:
    """Retrieved and evidence arrays of each item; evidence are the documents with any eight tokens in a row of the item, or all of a shorter one."""
    evidence = search.contains_windows(memories(spark, sf_dir), asked(spark, sf_dir)).groupBy("query_id").agg(F.collect_set("id").alias("evidence"))
    hits = found(memories(spark, sf_dir), asked(spark, sf_dir), _BM25)
    got = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("retrieved"))
    return got.join(evidence, "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<bigint>")))


@query(f"{_EVIDENCE} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in _NAMES)} FROM per")
def retrieval_metrics(spark, sf_dir):
    m = evaluate.metrics(evaluated(spark, sf_dir))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in _NAMES])


@query(f"{_EVIDENCE} SELECT count(*) AS questions, {', '.join(f'round(avg({c}), 5) AS {c}' for c in _NAMES)}, round(avg(CASE WHEN recall_10 = 0 THEN 1.0 ELSE 0.0 END), 5) AS miss_10 FROM per")
def eval_summary(spark, sf_dir):
    m = evaluate.metrics(evaluated(spark, sf_dir))
    return m.agg(F.count("*").alias("questions"), *[F.round(F.avg(c), 5).alias(c) for c in _NAMES], F.round(F.avg(F.when(F.col("recall_10") == 0, 1.0).otherwise(0.0)), 5).alias("miss_10"))
