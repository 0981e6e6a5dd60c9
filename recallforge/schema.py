"""Records of the engine: schemas, defaults, codecs of their enumerations."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Memory types, observation kinds, dataset kinds and run modes with their other names.
MEMORY_TYPES = ("working", "episodic", "semantic", "procedural", "reflection")
OBSERVATION_KINDS = ("assistant_fact", "attribute", "event", "preference", "temporal", "update")
DATASETS = {"locomo": "locomo", "longmemeval": "longmemeval", "long_mem_eval": "longmemeval", "lme": "longmemeval", "generic": "generic"}
MODES = {"retrieval": "retrieval", "retrieve": "retrieval", "answer": "answer", "qa": "answer"}

EVENT = "id string, namespace string, actor string, text string, metadata map<string,string>, created_at timestamp"
MEMORY = (
    "id string, namespace string, memory_type string, content string, source_event_id string, importance double, confidence double, "
    "metadata map<string,string>, created_at timestamp, updated_at timestamp, valid_from timestamp, valid_to timestamp, deleted_at timestamp"
)


class StoreError(Exception):
    """A store that can't be read or written as asked."""


class CorruptStore(StoreError):
    """A record that can't be decoded."""

    def __init__(self, message: str):
        super().__init__(f"corrupt store: {message}")


class DuplicateEvent(StoreError):
    """An event id that is there already."""


def memory_type(name: Column) -> Column:
    """Unknown and null types are episodic."""
    return F.when(name.isin(*MEMORY_TYPES), name).otherwise("episodic")


def clamped(x: Column) -> Column:
    return F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0))


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id from what a row holds, the same in every run."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 24))


def _filled(rows: DataFrame, schema: str, defaults: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns of ``schema``; those that are missing, and nulls where there is a default, are filled."""
    out = []
    for part in schema.replace("map<string,string>", "map<string;string>").split(", "):
        name, kind = part.replace(";", ",").split(" ")
        value = F.col(name) if name in rows.columns else F.lit(None)
        out.append((F.coalesce(value, defaults[name]) if name in defaults else value).cast(kind).alias(name))
    return rows.select(*out)


def events(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows with a text as events: actor user, namespace default, an id of their own, no metadata."""
    now = F.current_timestamp() if now is None else now
    given = rows if "id" in rows.columns else rows.withColumn("id", stable_id("evt", *[F.col(c) for c in rows.columns if c != "metadata"]))
    return _filled(given, EVENT, {"actor": F.lit("user"), "namespace": F.lit("default"), "metadata": F.create_map(), "created_at": now})


def memories(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows with a content as memories, with all defaults; importance and confidence are clamped to 0 to 1."""
    now = F.current_timestamp() if now is None else now
    given = rows if "id" in rows.columns else rows.withColumn("id", stable_id("mem", *[F.col(c) for c in rows.columns if c != "metadata"]))
    out = _filled(given, MEMORY, {"memory_type": F.lit("episodic"), "namespace": F.lit("default"), "importance": F.lit(0.5), "confidence": F.lit(0.75), "metadata": F.create_map(), "created_at": now, "updated_at": F.coalesce("created_at", now) if "created_at" in given.columns else now})
    return out.withColumns({"memory_type": memory_type(F.col("memory_type")), "importance": clamped(F.col("importance")), "confidence": clamped(F.col("confidence"))})


@dataclass
class MemoryQuery:
    """What to look for: eight memories of a namespace, of any type, valid now, without side channels."""

    text: str = ""
    namespace: str = "default"
    memory_types: list[str] = field(default_factory=list)
    limit: int = 8
    include_expired: bool = False
    include_side_channel: bool = False


@dataclass
class Turn:
    id: str
    speaker: str
    text: str
    timestamp: str | None = None


@dataclass
class Question:
    id: str
    conversation_id: str
    text: str
    gold_answers: list[str] = field(default_factory=list)
    evidence_turn_ids: list[str] = field(default_factory=list)
    category: str | None = None


def dataset_kind(name: str) -> str:
    if name.lower() not in DATASETS:
        raise ValueError(f"unknown dataset kind: {name}")
    return DATASETS[name.lower()]


def run_mode(name: str) -> str:
    if name.lower() not in MODES:
        raise ValueError(f"unknown mode: {name}")
    return MODES[name.lower()]


def dataset_hash(data: bytes) -> str:
    """A stable 16-digit name of a dataset's bytes."""
    return hashlib.sha256(data).hexdigest()[:16]
