"""The registered queries and their DuckDB counterparts, and the views of the driver's tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOK = r"list_transform(list_filter(string_split_regex(coalesce({0}, ''), '[^\p{{L}}\p{{N}}'']+'), lambda w: w <> ''), lambda w: regexp_replace(lower(w), '(''s|'')$', ''))"
SENT = r"list_filter(list_transform(string_split_regex(coalesce({0}, ''), '[.!?\n]'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def query(sql: str | None = None):
    """Registers a query (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events: a conversation is a namespace."""
    return table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as string) namespace", "turn seq", "concat(conv_id, '::', turn) event_id", "role actor", "text")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id id", "source", "text content")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").selectExpr("item_id query_id", "text")
