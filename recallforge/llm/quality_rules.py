"""Op 7, quality rules: thresholds per language and source from mergeable quantile sketches, then a joined filter.

A sketch holds counts per bucket of a value; buckets keep the six leading bits of an integer, so a quantile read from
it is at most 1/32 below the true one, and two sketches merge by adding counts, in any order and with the same result.
Spark's partial aggregation builds them, so a language or source of any size costs one row for each bucket and task.
Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, materialize

#: metric: (SQL of its integer value, least spread in the metric's unit, has a lower fence, has an upper fence)
METRICS = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", 20, False, True),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 50, False, True),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", 50, False, True),
    "word_length": ("100 * word_chars div greatest(n_words, 1)", 60, True, True),
}
FENCE, LEAST_ROWS, BROADCAST_ROWS, SALTS = 3, 50, 20_000, 64


def base_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long); the text itself goes.

    Windows of three words are compared by 64-bit digests.  A text without two equal digests, found by a hash set, ends
    there; else digests and places are sorted within the row.
    """
    t = docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    t = t.withColumn("__w", F.expr(f"filter(split(`{text_col}`, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"))
    t = t.withColumn("__l", F.expr(f"filter(split(`{text_col}`, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    t = t.withColumn("__d", F.expr("transform(__w, w -> xxhash64(w))")).withColumn("__m", F.expr("greatest(size(__w) - 2, 0)"))
    t = t.withColumn("__h", F.expr("zip_with(zip_with(slice(__d, 1, __m), slice(__d, 2, __m), (a, b) -> xxhash64(a, b)), slice(__d, 3, __m), (a, b) -> xxhash64(a, b))"))
    t = t.withColumn("__s", F.expr("if(size(array_distinct(__h)) = size(__h), cast(array() as array<struct<h:bigint,i:int>>), sort_array(transform(__h, (h, i) -> named_struct('h', h, 'i', i))))"))
    t = t.withColumn("__p", F.expr("transform(filter(__s, (s, j) -> s.h = get(__s, j - 1).h or s.h = get(__s, j + 1).h), s -> s.i)"))
    return t.withColumns({
        "n_words": F.expr("cast(size(__w) as long)"),
        "word_chars": F.expr("cast(length(array_join(__w, '')) as long)"),
        "n_symbols": F.expr(f"cast(length(regexp_replace(`{text_col}`, '[^#*$%&|<>]+', '')) as long)"),
        "n_lines": F.expr("cast(size(__l) as long)"),
        "n_dup_lines": F.expr("cast(size(__l) - size(array_distinct(__l)) as long)"),
        "n_repeat_words": F.expr("cast(size(array_distinct(concat(__p, transform(__p, p -> p + 1), transform(__p, p -> p + 2)))) as long)"),
    }).drop("__w", "__l", "__d", "__m", "__h", "__s", "__p", text_col)


def sketches(features: DataFrame, *keys: str) -> DataFrame:
    """The buckets of every metric for each value of ``keys``: (keys, metric, bucket, n)."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(sql).cast("long").alias("v")) for m, (sql, *_) in METRICS.items()]))
    rows = features.filter("n_words > 0").select(*keys, values.alias("x")).select(*keys, "x.metric", F.expr("shiftleft(shiftright(x.v, greatest(length(bin(x.v)) - 6, 0)), greatest(length(bin(x.v)) - 6, 0))").alias("bucket"))
    return rows.groupBy(*keys, "metric", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of ``keys``: its rows, and lowest and highest values allowed of each metric."""
    w = Window.partitionBy(*keys, "metric")
    cum = sketch.withColumn("c", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    q = cum.groupBy(*keys, "metric").agg(F.first("total").alias("rows"), F.min(F.expr("if(4 * c >= total, bucket, null)")).alias("q1"), F.min(F.expr("if(4 * c >= 3 * total, bucket, null)")).alias("q3"))
    aggs = [F.max("rows").alias("rows")]
    for m, (_, least, low, high) in METRICS.items():
        spread = f"{FENCE} * greatest(q3 - q1, {least})"
        aggs += [F.max(F.expr(f"if(metric = '{m}', q1 - {spread}, null)")).alias(f"{m}_min")] * low + [F.max(F.expr(f"if(metric = '{m}', q3 + {spread}, null)")).alias(f"{m}_max")] * high
    return q.groupBy(*keys).agg(*aggs) if keys else q.agg(*aggs)


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Base counts and the adaptive verdict for every row of ``docs``: id, counts, ``base_failed``, ``kept``.

    A document is kept if it passes the base rules (50 words; at most half of them in repeated windows) and no metric is
    outside its group's quartiles by more than 3 spreads.  Null languages and sources are groups of their own; groups
    of under 50 documents use the merged sketch of all.  Null and empty texts have 0 of everything and fail.  Repeated
    rows count and return each; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    features = materialize(base_features(rows), "rules")
    sketch = materialize(sketches(features, "lang", "source"), "rule-sketches")
    own = fences(sketch, "lang", "source").filter(f"rows >= {LEAST_ROWS}").select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[c for m, (_, _, a, b) in METRICS.items() for c in [f"{m}_min"] * a + [f"{m}_max"] * b])
    own = materialize(own, "rule-fences")
    whole = fences(sketch.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))).first().asDict()
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = features.join(F.broadcast(own), same, "left")
    else:  # more groups than a broadcast may hold: a salted join, so a hot group meets its fences in many tasks
        salted = own.withColumn("g_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = features.withColumn("salt", F.expr(f"cast(pmod(xxhash64(doc_id), {SALTS}) as int)")).join(salted, same & (F.col("salt") == F.col("g_salt")), "left")
    verdict = F.lit(True)
    for m, (sql, _, low, high) in METRICS.items():
        value = F.expr(sql).cast("long")
        if low:
            verdict &= F.coalesce(value >= F.coalesce(f"{m}_min", F.lit(whole[f"{m}_min"]).cast("long")), F.lit(True))
        if high:
            verdict &= F.coalesce(value <= F.coalesce(f"{m}_max", F.lit(whole[f"{m}_max"]).cast("long")), F.lit(True))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict).alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all documents; null and empty texts, languages and sources, and repeated rows, as in ``quality_rules``."""
    return quality_rules(documents(spark, sf_dir, "doc_id", "lang", "source", "text"))


_VALUES = {m: sql.replace(" div ", " // ") for m, (sql, *_) in METRICS.items()}
_BOUNDS = [(m, "min", least) for m, (_, least, low, _) in METRICS.items() if low] + [(m, "max", least) for m, (_, least, _, high) in METRICS.items() if high]


def _edges(rows: str, keys: str) -> str:
    cols = ", ".join(f"max(CASE WHEN metric = '{m}' THEN {'q1 -' if k == 'min' else 'q3 +'} {FENCE} * greatest(q3 - q1, {least}) END) AS {m}_{k}" for m, k, least in _BOUNDS)
    by = f"{keys}, " if keys else ""
    return f"""SELECT {by}max(total) AS total, {cols} FROM (
      SELECT {by}metric, max(total) AS total, min(CASE WHEN 4 * c >= total THEN bucket END) AS q1, min(CASE WHEN 4 * c >= 3 * total THEN bucket END) AS q3 FROM (
        SELECT *, sum(n) OVER (PARTITION BY {by}metric ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY {by}metric) AS total FROM {rows}) GROUP BY {by}metric) {'GROUP BY ' + keys if keys else ''}"""


ORACLE = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
nl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
ws AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM d),
tri AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS t FROM ws WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri WHERE t IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY doc_id),
f AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN nl USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, CAST({sql} AS BIGINT) AS v FROM f WHERE n_words > 0" for m, sql in _VALUES.items())}),
b AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 6, 0)::INT) << greatest(length(bin(v)) - 6, 0)::INT AS bucket, count(*) AS n FROM v GROUP BY ALL),
own AS ({_edges('b', 'lang, source')}),
allb AS (SELECT metric, bucket, sum(n) AS n FROM b GROUP BY ALL),
whole AS ({_edges('allb', '')})
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {" AND ".join(f"coalesce({_VALUES[m]} {'>=' if k == 'min' else '<='} coalesce(own.{m}_{k}, whole.{m}_{k}), true)" for m, k, _ in _BOUNDS)} AS kept
FROM f CROSS JOIN whole LEFT JOIN own ON f.lang IS NOT DISTINCT FROM own.lang AND f.source IS NOT DISTINCT FROM own.source AND own.total >= {LEAST_ROWS}
"""
