"""Judges of answers, metrics of retrieval, and their summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallforge.functions.dates import fits_or_same_date
from recallforge.functions.normal import lenient
from recallforge.functions.text import squeeze

DEPTHS = (1, 3, 5, 10, 20, 50, 100, 200)


def _contained(a: Column, gold: Column, empty_is_right: bool) -> Column:
    some = F.exists(gold, lambda g: (g != "") & (F.contains(a, g) | F.contains(g, a)))
    return some if empty_is_right else (a != "") & some


def exact_judge(answer: Column, gold: Column, empty_is_right: bool = False) -> Column:
    """Containment either way of the squeezed texts, with any gold answer.

    An empty answer is contained in every gold answer; it is wrong unless ``empty_is_right``.
    """
    return _contained(squeeze(answer), F.transform(gold, squeeze), empty_is_right)


def lenient_judge(answer: Column, gold: Column, empty_is_right: bool = False) -> Column:
    """Containment either way of the lenient forms, or about the same date."""
    return fits_or_same_date(empty_is_right)(lenient(answer), F.transform(gold, lenient)).cast("boolean")


#: Judges by name; others can be added.
JUDGES: dict[str, Callable[[Column, Column], Column]] = {"exact": exact_judge, "normalized": lenient_judge}


def judged(answers: DataFrame, judge: str | Callable[[Column, Column], Column] = "exact", answer_col: str = "answer", gold_col: str = "gold_answers") -> DataFrame:
    """``answers`` with ``correct``, ``judge_score`` and ``judge_reason``."""
    call = JUDGES[judge] if isinstance(judge, str) else judge
    out = answers.withColumn("correct", F.coalesce(call(F.col(answer_col), F.col(gold_col)), F.lit(False)))
    return out.withColumns({"judge_score": F.col("correct").cast("double"), "judge_reason": F.when(F.col("correct"), "a gold answer matches").otherwise("no gold answer matches")})


def recall_at(k: int, evidence: Column, retrieved: Column) -> Column:
    """Share of the evidence among the first ``k`` retrieved; 0 without evidence."""
    n = F.size(F.array_distinct(evidence))
    return F.when(n <= 0, 0.0).otherwise(F.size(F.array_intersect(F.slice(retrieved, 1, k), evidence)) / n)


def mrr(evidence: Column, retrieved: Column) -> Column:
    at = F.transform(retrieved, lambda x, i: F.when(F.array_contains(evidence, x), i + 1))
    return F.coalesce(1.0 / F.array_min(F.filter(at, lambda x: x.isNotNull())), F.lit(0.0))


def ndcg_at(k: int, evidence: Column, retrieved: Column) -> Column:
    first = F.slice(F.array_distinct(retrieved), 1, k)
    gain = F.aggregate(F.transform(first, lambda x, i: F.when(F.array_contains(evidence, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    n = F.least(F.size(F.array_distinct(evidence)), F.lit(k))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: 1.0 / F.log2(i + 1.0)), F.lit(0.0), lambda a, x: a + x)
    return F.when(n <= 0, 0.0).otherwise(gain / ideal)


def metrics(results: DataFrame, depths: tuple[int, ...] = DEPTHS, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row's evidence and retrieved arrays as recall at several depths, MRR and NDCG@5; nulls in ``retrieved`` are left out."""
    rows = results.withColumn("retrieved", F.filter("retrieved", lambda x: x.isNotNull()))
    e, r = F.col("evidence"), F.col("retrieved")
    return rows.select("query_id", *keep, *[recall_at(k, e, r).alias(f"recall_{k}") for k in depths], mrr(e, r).alias("mrr"), ndcg_at(5, e, r).alias("ndcg_5"))


def summarize(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over all questions, those without evidence too; accuracy of those that were answered (null if none).

    ``results`` have metrics, and ``correct`` (null: not answered) where there were answers.  A question is missed if none of
    its evidence is among the first ten; an answer is wrong with evidence if some is, wrong with first if the first hit is.
    """
    names = [c for c in results.columns if c.startswith(("recall_", "mrr", "ndcg"))]
    correct = F.col("correct").cast("boolean") if "correct" in results.columns else F.lit(None).cast("boolean")

    def share(c: Column) -> Column:
        return F.avg(F.when(c, 1.0).otherwise(0.0))

    aggregates = [
        F.count("*").alias("questions"), *[F.avg(c).alias(c) for c in names], F.count(correct).alias("answered"), F.avg(correct.cast("int")).alias("accuracy"), share(F.col("recall_10") <= 0).alias("miss_10"),
        share((F.col("recall_10") > 0) & ~correct).alias("wrong_with_evidence"), share((F.col("recall_1") > 0) & ~correct).alias("wrong_with_first"),
    ]
    if "latency_ms" in results.columns:
        aggregates.append(F.avg("latency_ms").alias("latency_ms"))
    return results.groupBy(*by).agg(*aggregates)


def missed(results: DataFrame, n: int) -> DataFrame:
    """The first ``n`` questions whose evidence is not among the first ten."""
    return results.filter("recall_10 = 0").orderBy("query_id").limit(n)


def gold_ranks(results: DataFrame) -> DataFrame:
    """(query_id, gold, rank) of every evidence id; null if it was not retrieved."""
    rank = F.array_position(F.coalesce("retrieved", F.array().cast("array<string>")).cast("array<string>"), F.col("gold").cast("string"))
    return results.select("query_id", F.explode("evidence").alias("gold"), "retrieved").select("query_id", "gold", F.nullif(rank, F.lit(0)).alias("rank"))
