"""Command line: ``bench`` runs a dataset's questions, ``missed`` explains those whose evidence was not found."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from recallforge import benchmark
from recallforge.operators.answer import ANSWERERS
from recallforge.operators.evaluate import JUDGES
from recallforge.operators.ingest import ingest_dataset
from recallforge.operators.rerank import RERANKERS, one_line
from recallforge.sources import datasets


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="recallforge", description=__doc__)
    out.add_argument("command", choices=("bench", "missed"))
    out.add_argument("--dataset", required=True)
    out.add_argument("--kind", default="generic")
    out.add_argument("--mode", default="retrieval")
    out.add_argument("--answerer", default="basic", choices=sorted(ANSWERERS))
    out.add_argument("--judge", default="exact", choices=sorted(JUDGES))
    out.add_argument("--reranker", default="none", choices=sorted(RERANKERS))
    out.add_argument("--evidence-pack", default="two-stage", dest="pack")
    out.add_argument("--top-k", type=int, default=10)
    out.add_argument("--offset", type=int, default=0)
    out.add_argument("--limit", type=int)
    out.add_argument("--output", default="")
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = vars(parser().parse_args(args))
    command = given.pop("command")
    try:
        config = benchmark.RunConfig(**given)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("recallforge").getOrCreate()
    report = benchmark.load_and_run(spark, config)
    if command == "bench":
        print(benchmark.report_text(config, report.summary.first().asDict()))
        return 0
    turns, questions = datasets.load_dataset(spark, config.dataset, config.kind)
    for r in benchmark.missed_report(report, ingest_dataset(turns)).collect():
        place = "not among the hits" if r.rank is None else f"rank {r.rank}"
        print(one_line(f"{r.question_id}: {r.gold}, {place}, in {r.stored} memories"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
