"""Op 9, mixing sources to target weights: Poisson replication with a hash-seeded uniform number per document.

A source's mean repetition rate is the rows it should have over those it has.  A document's count is the Poisson
distribution of that mean inverted at a number in [0, 1) taken from a digest of seed and id, so a run can be repeated
and every task decides alone.  Copies are exploded, and dealt and ordered by a digest of (seed, id, copy): a global
shuffle without a range-sampling pass.  Rows of one key, as those without an id, are dealt by their other columns too, so
no partition gets all of them.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize

BROADCAST_BYTES, SALTS = 16 << 20, 64


def _digest(digits: int, *parts: Column | str) -> Column:
    """The first ``digits`` (up to 15) hex digits of an MD5 sum as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float, power: float, source_col: str) -> DataFrame:
    """(source, cuts): the values of the cumulative Poisson distribution of each source's mean rate."""
    n = docs.groupBy(F.col(source_col).alias("m_source")).agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow("n", F.lit(power)))
    else:
        given = F.map_from_arrays(F.array(*map(F.lit, weights)), F.array(*[F.lit(float(w)) for w in weights.values()]))
        n = n.withColumn("w", F.coalesce(F.try_element_at(given, F.col("m_source")), F.lit(0.0)))
    n = materialize(n, "mix-counts")
    total = n.agg(F.sum("n"), F.sum("w")).first()
    n = n.withColumn("rate", F.lit(epochs * (total[0] or 0.0)) * F.col("w") / F.lit(total[1] or 1.0) / F.col("n"))
    # in logarithms, so no rate is too large
    steps = "sequence(1, cast(ceil(rate + 12 * sqrt(rate) + 30) as int))"
    cuts = f"aggregate({steps}, named_struct('lp', -rate, 'c', exp(-rate), 'all', array(exp(-rate))), (a, j) -> named_struct('lp', a.lp + ln(rate) - ln(j), 'c', a.c + exp(a.lp + ln(rate) - ln(j)), 'all', array_append(a.all, a.c + exp(a.lp + ln(rate) - ln(j)))), a -> a.all)"
    return n.select("m_source", F.expr(f"if(rate > 0, {cuts}, array(1.0D))").alias("cuts"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, power: float = 0.5, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Replicates and shuffles ``docs``; adds ``replica`` (1, 2, ...) and ``mix_key`` (the global order).

    ``weights`` gives each source's share of the result (sources without one go); by default shares follow the number
    of documents to the power ``power``.  The result has about ``epochs`` times the rows of ``docs``.  Null sources are
    a source of their own (its weight cannot be given by name); null ids share one draw, as do repeated ids, each row
    being replicated by itself.  Texts may be null, empty or long.  Columns named replica or mix_key are replaced.
    """
    base = docs.drop("replica", "mix_key")
    cuts = materialize(rates(base, weights, epochs, power, source_col), "mix-rates")
    u = _digest(13, F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))) / F.lit(float(1 << 52))
    same = F.col(source_col).eqNullSafe(F.col("m_source"))
    size = cuts.agg(F.sum(F.coalesce(F.octet_length("m_source"), F.lit(0)) + 8 * F.size("cuts") + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = base.join(F.broadcast(cuts), same)
    else:
        joined = base.withColumn("m_salt", _digest(15, F.lit("salt"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % SALTS).join(cuts.withColumn("m_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col("m_salt") == F.col("m_of"))).drop("m_salt", "m_of")
    copies = joined.withColumn("m_u", u).withColumn("m_n", F.expr("size(filter(cuts, c -> c <= m_u))")).filter("m_n > 0")
    copies = copies.withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("m_n")))).select(*base.columns, "replica")
    keyed = copies.withColumn("mix_key", _digest(15, F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("replica").cast("string")))
    # rows that share a key, as all that have no id do, are dealt by what else they hold
    return keyed.repartition("mix_key", F.xxhash64(*base.columns)).sortWithinPartitions("mix_key")


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents at the default weights; null and repeated ids and sources as in ``mix_sources``."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"))


def mixed_sql(table: str) -> str:
    """DuckDB SQL of ``mix_sources`` with its defaults over the columns of documents."""
    return f"""
WITH RECURSIVE n AS (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM {table} GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM n) * sqrt(n) / (SELECT sum(sqrt(n)) FROM n) / n AS rate FROM n),
c AS (SELECT source, rate, 0 AS j, -rate AS lp, exp(-rate) AS c FROM r
  UNION ALL SELECT source, rate, j + 1, lp + ln(rate) - ln(j + 1), c + exp(lp + ln(rate) - ln(j + 1)) FROM c WHERE j < ceil(rate + 12 * sqrt(rate) + 30)),
cuts AS (SELECT source, list(c ORDER BY j) AS cuts FROM c GROUP BY source),
k AS (SELECT d.*, len(list_filter(cuts, lambda x: x <= CAST(('0x' || substr(md5('mix:' || doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0)) AS k FROM {table} d JOIN cuts ON d.source IS NOT DISTINCT FROM cuts.source)
SELECT doc_id, text, lang, source, n_chars, CAST(replica AS INTEGER) AS replica, CAST(('0x' || substr(md5('mix:' || doc_id || ':' || replica), 1, 15)) AS BIGINT) AS mix_key
FROM (SELECT *, unnest(range(1, k + 1)) AS replica FROM k)
"""


ORACLE = mixed_sql("documents")
