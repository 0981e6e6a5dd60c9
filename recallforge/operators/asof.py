"""As-of joins: for every question the version that was the latest one at its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(questions: DataFrame, versions: DataFrame, by: list[str], at: str, since: str, seq: str, span: str = "1 day") -> DataFrame:
    """``questions`` with ``version``, a struct of the last row of ``versions`` of the same ``by`` whose ``since`` is not after ``at``; null if there is none.

    Of versions of one time the one with the largest ``seq`` counts; a version at a question's very time counts.  Questions
    without a time or without a key have no version; versions without a time are none.  No pair is built: both sides are
    sorted together by key and time.  Time is cut into spans, so that a key of very many rows is many small sorts; a span
    without an earlier version of its own takes the last one of the spans before it, from one row a key and span.
    """
    length = F.expr(f"unix_micros(timestamp '1970-01-01 00:00:00' + interval {span}) - unix_micros(timestamp '1970-01-01 00:00:00')")

    def slot(time: Column) -> Column:
        return F.floor(F.unix_micros(time.cast("timestamp")) / length)

    kind = versions.schema.simpleString()
    known = versions.filter(F.col(since).isNotNull()).na.drop(subset=by)
    right = known.select(*by, F.col(since).cast("timestamp").alias("_t"), F.col(seq).cast("long").alias("_n"), F.lit(0).alias("_side"), F.struct(*versions.columns).alias("version"), F.lit(None).cast(questions.schema.simpleString()).alias("_q"))
    left = questions.select(*by, F.col(at).cast("timestamp").alias("_t"), F.lit(None).cast("long").alias("_n"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("version"), F.struct(*questions.columns).alias("_q"))
    both = right.unionByName(left).withColumn("_slot", slot(F.col("_t")))
    within = Window.partitionBy(*by, "_slot").orderBy("_t", "_side", "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("version", F.last("version", ignorenulls=True).over(within)).filter("_side = 1").select(*by, "_slot", "_q", "version")
    # the last version of each span, and what a span inherits: one row for each key and span with questions or versions
    lasts = right.withColumn("_slot", slot(F.col("_t"))).groupBy(*by, "_slot").agg(F.max_by("version", F.struct("_t", "_n")).alias("_last"))
    spans = both.select(*by, "_slot").distinct().join(lasts, [*by, "_slot"], "left")
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).select(*by, "_slot", "_carried")
    found = near.join(carried, [*by, "_slot"], "left")
    return found.select("_q.*", F.coalesce("version", "_carried").alias("version"))


def valid(version: Column, at: Column) -> Column:
    """Whether a memory's version, a struct, is there, not deleted, and valid at a time."""
    begun = version["valid_from"].isNull() | (version["valid_from"] <= at)
    open_ = version["valid_to"].isNull() | (version["valid_to"] >= at)
    return F.coalesce(version["id"].isNotNull() & version["deleted_at"].isNull() & begun & open_, F.lit(False))
