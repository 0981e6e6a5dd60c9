"""A corpus pipeline of five stages; each works on all that the one before it kept.

Toxic documents go, one document of each near-duplicate component stays, contaminated documents go, secrets are
replaced in the texts, and the rest is mixed to target weights of the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recallforge.llm._common import materialize
from recallforge.llm.decontaminate import remove_contaminated
from recallforge.llm.mixing import mix_sources
from recallforge.llm.near_dups import drop_near_duplicates
from recallforge.llm.secrets import redact_secrets
from recallforge.llm.toxicity import HELD_OUT, learn, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subsequence-kernel machine scores under 0.3.

    Null and empty texts have no units and score low, so they stay; repeated rows are scored each; labels without an id or a
    value are not learned from, and without labels nothing goes.
    """
    model = learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), f"not ({HELD_OUT})")
    return score_toxicity(docs, model).filter("predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component: five-word shingles, similarity of 0.8 or more.

    Null and empty texts, and rows without an id, stay; repeated rows of a kept id stay.
    """
    return drop_near_duplicates(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is in windows of the benchmark.

    Null and empty texts stay; repeated rows are judged each; an empty benchmark drops nothing.
    """
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced; null and empty texts stay as they are, repeated rows are redacted each."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the sources' target weights and shuffled; adds replica and mix_key.

    Null sources are a source of their own; rows without an id share one draw, as do repeated ids.
    """
    return mix_sources(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scans", secret_scans), ("mixing", mixing)]

#: Trained scores and spans in texts can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
