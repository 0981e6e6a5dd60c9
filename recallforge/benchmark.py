"""Runs of a dataset's questions: ingest, search, rerank, evidence, answers, judging, and the files of a report."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge import schema
from recallforge.operators import answer, evaluate, evidence, ingest, rerank, retrieve, search
from recallforge.providers import LlmProvider
from recallforge.sources import datasets
from recallforge.sources.shared import read_bytes, write_text


@dataclass
class RunConfig:
    """What to run; the defaults are those of a retrieval run."""

    dataset: str = ""
    kind: str = "generic"
    mode: str = "retrieval"
    answerer: str = "basic"
    judge: str = "exact"
    reranker: str = "none"
    pack: str = "two-stage"
    top_k: int = 10
    offset: int = 0
    limit: int | None = None
    output: str = ""
    side_channel: bool = True

    def __post_init__(self) -> None:
        self.kind, self.mode = schema.dataset_kind(self.kind), schema.run_mode(self.mode)
        for name, known in ((self.answerer, answer.ANSWERERS), (self.judge, evaluate.JUDGES), (self.reranker, rerank.RERANKERS)):
            if name not in known:
                raise ValueError(f"unknown strategy: {name}")
        if self.top_k < 1:
            raise ValueError("top_k must be 1 at least")


@dataclass
class Report:
    """Results by question, and their summary."""

    results: DataFrame
    summary: DataFrame
    config: RunConfig


def run(spark: SparkSession, turns: DataFrame, questions: DataFrame, config: RunConfig, extracted: DataFrame | None = None, expander: LlmProvider | None = None, model: answer.Answerer | None = None, reranker: rerank.Rerank | None = None) -> Report:
    """Answers and judges the selected questions over memories of the conversations that they are about.

    ``extracted`` are candidates of a model instead of the rules', ``expander`` words questions anew, ``model`` and
    ``reranker`` take the place of the strategies named in ``config``.  What several steps read is persisted; unpersist the
    results when the report is done with.
    """
    asked, needed = datasets.selected(questions, turns, config.offset, config.limit)
    needed = needed.persist()
    memories = ingest.ingest_dataset(needed, extracted).persist()
    pack = evidence.Pack(config.pack, config.top_k, config.mode == "answer")
    queries = asked.select(F.col("id").alias("query_id"), F.col("conversation_id").alias("namespace"), "text")
    plan = search.Search(limit=pack.search_limit)
    visible = memories.filter(~F.coalesce(F.map_contains_key("metadata", F.lit("side_channel")), F.lit(False)))
    hits = search.search(visible, queries, plan).withColumn("reasons", search.reasons())
    if expander is not None:
        hits = _fused(visible, queries, expander, plan, hits)
    pools = evidence.candidates(hits, memories).persist()
    texts = queries.select("query_id", "text")
    if config.mode == "answer" and (reranker is not None or config.reranker != "none"):
        pools = rerank.reranked(pools.join(texts, "query_id"), reranker or config.reranker).select("query_id", "candidates")
    got = asked.select(F.col("id").alias("query_id"), "conversation_id", "text", "category", "gold_answers", F.col("evidence_turn_ids").alias("evidence_ids")).join(pools, "query_id", "left")
    top = F.slice(F.coalesce("candidates", F.array().cast(f"array<{evidence.PACKET}>")), 1, config.top_k)
    got = got.withColumns({"retrieved": F.transform(top, lambda p: p["source_event_id"]), "memory_ids": F.transform(top, lambda p: p["id"])})
    measured = evaluate.metrics(got.withColumn("evidence", F.col("evidence_ids")), keep=("conversation_id", "category", "gold_answers", "evidence_ids", "memory_ids", "retrieved"))
    if config.mode == "answer":
        found = evidence.evidence(got.select("query_id", "conversation_id", "text"), pools, memories, needed, pack, config.side_channel)
        inputs = datasets.check_no_gold(texts.join(found, "query_id"))
        answers = answer.answered(inputs, model or config.answerer).select("query_id", "answer")
        measured = evaluate.judged(measured.join(answers, "query_id", "left"), config.judge)
    results = measured.withColumnRenamed("query_id", "question_id").persist()
    return Report(results, evaluate.summarize(results), config)


def _fused(memories: DataFrame, queries: DataFrame, expander: LlmProvider, plan: search.Search, hits: DataFrame) -> DataFrame:
    """The hits of a question and of its other wordings, by the best score of each memory."""
    more = rerank.expanded(queries, expander).filter("variant > 0").join(queries.select("query_id", "namespace"), "query_id")
    worded = more.select(F.concat_ws("\x1f", "query_id", "variant").alias("key"), "query_id", "namespace", "text")
    found = search.search(memories, worded.select(F.col("key").alias("query_id"), "namespace", "text"), plan).withColumn("reasons", search.reasons())
    both = hits.unionByName(found.withColumnRenamed("query_id", "key").join(worded.select("key", "query_id"), "key").drop("key"))
    best = both.groupBy("query_id", "id").agg(F.max_by(F.struct(*[c for c in both.columns if c not in ("query_id", "id", "rank")]), "score").alias("b")).select("query_id", "id", "b.*")
    return retrieve.top(best, plan.limit)


def missed_report(report: Report, memories: DataFrame, n: int = 5) -> DataFrame:
    """(question_id, gold, rank, stored) of the first missed questions: where each evidence id is among the hits, and how many memories have it as a source."""
    some = evaluate.missed(report.results.withColumnRenamed("question_id", "query_id"), n)
    ranks = evaluate.gold_ranks(some.withColumnRenamed("evidence_ids", "evidence"))
    stored = memories.groupBy(F.col("source_event_id").alias("gold")).agg(F.count("*").alias("stored"))
    return ranks.join(stored, "gold", "left").select(F.col("query_id").alias("question_id"), "gold", "rank", F.coalesce("stored", F.lit(0)).alias("stored"))


def write_outputs(report: Report, folder: str, dataset: bytes = b"") -> None:
    """manifest.json, summary.json, report.md, and scores.jsonl as a folder of JSON lines that tasks write."""
    spark, folder = report.results.sparkSession, folder.rstrip("/")
    report.results.write.mode("overwrite").json(f"{folder}/scores.jsonl")
    summary = report.summary.first().asDict()
    manifest = {"config": asdict(report.config), "dataset_hash": schema.dataset_hash(dataset)}
    for name, value in (("manifest.json", manifest), ("summary.json", summary)):
        write_text(spark, f"{folder}/{name}", json.dumps(value, indent=2, sort_keys=True))
    write_text(spark, f"{folder}/report.md", report_text(report.config, summary))


def report_text(config: RunConfig, summary: dict) -> str:
    lines = [f"# {config.kind}, {config.mode}", "", "| measure | value |", "|-|-|"]
    return "\n".join([*lines, *(f"| {k} | {'-' if v is None else f'{v:.4f}' if isinstance(v, float) else v} |" for k, v in summary.items()), ""])


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(f"{folder.rstrip('/')}/scores.jsonl")


def load_and_run(spark: SparkSession, config: RunConfig) -> Report:
    """A run over a dataset file, with its report written to ``config.output`` if that is set."""
    turns, questions = datasets.load_dataset(spark, config.dataset, config.kind)
    report = run(spark, turns, questions, config)
    if config.output:
        write_outputs(report, config.output, read_bytes(spark, config.dataset))
    return report
