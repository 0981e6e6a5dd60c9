"""Conversation datasets with questions: two published layouts and a lenient reading of others, as tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.schema import Question, Turn, dataset_kind

# Names that files use for the same thing, in the order in which they are looked for.
RECORDS = ("conversations", "data", "samples", "dialogs", "dialogues")
CONVERSATION_ID = ("conversation_id", "conversationId", "dialogue_id", "dialogueId", "sample_id", "id")
TURNS = ("turns", "messages", "conversation", "dialogue", "sessions", "haystack_sessions")
NESTED = ("turns", "messages", "dialogue")
TURN_TEXT = ("text", "content", "message", "utterance", "response")
TURN_ID = ("id", "turn_id", "turnId", "message_id")
SPEAKER = ("speaker", "role", "sender", "author")
TIME = ("timestamp", "time", "date")
QUESTIONS = ("questions", "qa", "qas", "qa_pairs", "evaluation")
QUESTION_TEXT = ("question", "query", "input", "text")
QUESTION_ID = ("id", "question_id", "questionId", "qid")
ANSWERS = ("gold_answers", "gold_answer", "answers", "answer", "target", "reference")
EVIDENCE = ("evidence_turn_ids", "evidence", "evidence_ids", "supporting_turns", "target_turn_ids")
CATEGORY = ("category", "type", "question_type")
INSIDE = ("id", "turn_id", "text", "answer", "content")

Conversations = list[tuple[str, list[Turn]]]


class DatasetError(ValueError):
    """A file that holds no dataset."""


def _text(value: Any) -> str | None:
    """A string that isn't empty, or a number as it is written; else null."""
    if isinstance(value, str):
        return value or None
    return json.dumps(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def first_text(record: Any, names: tuple[str, ...]) -> str | None:
    if not isinstance(record, dict):
        return None
    return next((t for n in names if (t := _text(record.get(n))) is not None), None)


def first_list(record: Any, names: tuple[str, ...]) -> list | None:
    if not isinstance(record, dict):
        return None
    return next((record[n] for n in names if isinstance(record.get(n), list)), None)


def texts(value: Any) -> list[str]:
    """The strings in a value: null is the answer None, arrays are flattened, of an object its first known name, truth values are none."""
    if value is None:
        return ["None"]
    if isinstance(value, list):
        return [t for v in value for t in texts(v)]
    if isinstance(value, dict):
        return next((found for n in INSIDE if n in value and (found := texts(value[n]))), [])
    if isinstance(value, str):
        return [value]
    found = _text(value)
    return [] if found is None else [found]


def first_texts(record: dict, names: tuple[str, ...]) -> list[str]:
    return next((found for n in names if n in record and (found := texts(record[n]))), [])


def scoped(scope: str, id_: str) -> str:
    return f"{scope}::{id_}"


def flat(values: list) -> list:
    """Turns that may be nested in sessions, to any depth."""
    out = []
    for v in values:
        inner = first_list(v, NESTED)
        out += [v] if inner is None else flat(inner)
    return out


def sessions_layout(records: Any) -> tuple[Conversations, list[Question]] | None:
    """Records with a ``conversation`` of numbered sessions, and ``qa``."""
    if not isinstance(records, list) or not records or not isinstance(records[0], dict) or "conversation" not in records[0]:
        return None
    conversations: Conversations = []
    questions: list[Question] = []
    for k, record in enumerate(records):
        name, talk = first_text(record, ("sample_id",)) or f"locomo-{k}", record.get("conversation")
        if not isinstance(talk, dict):
            raise DatasetError("a record without a conversation object")
        numbers = sorted(int(m[1]) for key in talk if (m := re.fullmatch(r"session_\+?(\d+)", key)))
        turns = []
        for n in numbers:
            time, session = talk.get(f"session_{n}_date_time"), talk.get(f"session_{n}")
            for i, t in enumerate(session if isinstance(session, list) else []):
                if text := first_text(t, ("text", "content")):
                    id_ = first_text(t, ("dia_id", "id")) or f"s{n}:t{i}"
                    turns.append(Turn(scoped(name, id_), first_text(t, ("speaker", "role")) or "unknown", text, time if isinstance(time, str) else None))
        conversations.append((name, turns))
        for i, q in enumerate(record.get("qa") or []):
            if text := first_text(q, ("question",)):
                category, gold = first_text(q, ("category",)), first_texts(q, ANSWERS)
                if category == "5" and not gold:  # questions that can't be answered
                    gold = ["None"]
                questions.append(Question(f"{name}:q:{i}", name, text, gold, [scoped(name, e) for e in first_texts(q, EVIDENCE)], category))
    return conversations, questions


def haystack_layout(records: Any) -> tuple[Conversations, list[Question]] | None:
    """Records of one question each, with ``haystack_sessions`` and parallel arrays of their ids and dates."""
    if not isinstance(records, list) or not records or not isinstance(records[0], dict) or "haystack_sessions" not in records[0]:
        return None
    conversations: Conversations = []
    questions: list[Question] = []
    for k, record in enumerate(records):
        name = first_text(record, ("question_id",)) or f"longmemeval-question-{k}"
        sessions, ids, dates = (record.get(f"haystack_{x}") or [] for x in ("sessions", "session_ids", "dates"))
        turns, evidence = [], []
        for i, session in enumerate(sessions):
            own = ids[i] if i < len(ids) and isinstance(ids[i], str) else f"{name}:session:{i}"
            time = dates[i] if i < len(dates) and isinstance(dates[i], str) else None
            for j, t in enumerate(session if isinstance(session, list) else []):
                if text := first_text(t, ("content", "text", "message")):
                    turn = Turn(scoped(name, f"session:{i}:{own}:turn:{j}"), first_text(t, ("role", "speaker")) or "unknown", text, time)
                    turns.append(turn)
                    if t.get("has_answer") is True:
                        evidence.append(turn.id)
        evidence = evidence or [scoped(name, e) for e in (texts(record["answer_session_ids"]) if "answer_session_ids" in record else [])]
        conversations.append((name, turns))
        questions.append(Question(name, name, first_text(record, ("question",)) or "", first_texts(record, ANSWERS), evidence, first_text(record, ("question_type",))))
    return conversations, questions


def whole_layout(value: Any) -> tuple[Conversations, list[Question]] | None:
    """An object that has this engine's own tables: conversations with turns, and questions, with all their fields."""
    try:
        conversations = [(c["id"], [Turn(t["id"], t["speaker"], t["text"], t.get("timestamp")) for t in c["turns"]]) for c in value["conversations"]]
        questions = [Question(q["id"], q["conversation_id"], q["text"], q["gold_answers"], q["evidence_turn_ids"], q.get("category")) for q in value["questions"]]
        return (conversations, questions) if isinstance(value["name"], str) and isinstance(value["version"], str) else None
    except (KeyError, TypeError):
        return None


def lenient_layout(value: Any) -> tuple[Conversations, list[Question]]:
    """Any records with turns and questions under known names."""
    records = value if isinstance(value, list) else first_list(value, RECORDS)
    conversations: Conversations = []
    questions: list[Question] = []
    for k, record in enumerate([value] if records is None else records):
        name = first_text(record, CONVERSATION_ID) or f"conversation-{k}"
        turns = []
        for i, t in enumerate(flat(first_list(record, TURNS) or [])):
            if text := first_text(t, TURN_TEXT):
                turns.append(Turn(first_text(t, TURN_ID) or f"{name}:turn:{i}", first_text(t, SPEAKER) or "unknown", text, first_text(t, TIME)))
        if turns:
            conversations.append((name, turns))
        asked = first_list(record, QUESTIONS)
        if asked is None:
            asked = [record] if first_text(record, ("question", "query")) else []
        for i, q in enumerate(asked):
            if text := first_text(q, QUESTION_TEXT):
                questions.append(Question(first_text(q, QUESTION_ID) or f"{name}:question:{i}", first_text(q, ("conversation_id", "conversationId")) or name, text, first_texts(q, ANSWERS), first_texts(q, EVIDENCE), first_text(q, CATEGORY)))
    return conversations, questions


def parse_dataset(value: Any, kind: str = "generic") -> tuple[Conversations, list[Question]]:
    """Conversations and questions of a JSON value; raises if there are none."""
    own = {"locomo": sessions_layout, "longmemeval": haystack_layout, "generic": lambda _: None}[dataset_kind(kind)]
    known = own(value) or whole_layout(value)
    if known is not None:
        return known
    if value in ([], {}) or (isinstance(value, dict) and first_list(value, RECORDS) == []):
        raise DatasetError("dataset contains no conversation records")
    conversations, questions = lenient_layout(value)
    if not conversations:
        raise DatasetError("dataset contains no turns")
    if not questions:
        raise DatasetError("dataset contains no questions")
    return conversations, questions


_TURNS = "conversation_id string, turn_index int, id string, speaker string, text string, timestamp string"
_QUESTIONS = "question_index int, id string, conversation_id string, text string, gold_answers array<string>, evidence_turn_ids array<string>, category string"


def load_dataset(spark: SparkSession, path: str, kind: str = "generic") -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of JSON files, each read whole in one task; raises in the job that reads a file without a dataset."""
    files = spark.read.text(path, wholetext=True).select("value")

    def tables(part: int, schema: str) -> DataFrame:
        names = [f.split(" ")[0] for f in schema.split(", ")]

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for value in batch["value"]:
                    conversations, questions = parse_dataset(json.loads(value), kind)
                    if part == 0:
                        rows = [{"conversation_id": c, "turn_index": i, **asdict(t)} for c, turns in conversations for i, t in enumerate(turns)]
                    else:
                        rows = [{"question_index": i, **asdict(q)} for i, q in enumerate(questions)]
                    yield pd.DataFrame(rows, columns=names)

        return files.mapInPandas(read, schema)

    return tables(0, _TURNS), tables(1, _QUESTIONS)


def selected(questions: DataFrame, turns: DataFrame, offset: int = 0, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A slice of the questions in their order, and the turns of the conversations that it needs."""
    some = questions.filter(F.col("question_index") >= offset)
    if limit is not None:
        some = some.filter(F.col("question_index") < offset + limit)
    return some, turns.join(some.select("conversation_id").distinct(), "conversation_id", "left_semi")


# What an answerer may see of a question, and what a judge may.
FOR_ANSWERER = ("id", "conversation_id", "text", "category")
FOR_JUDGE = ("id", "text", "gold_answers", "category")
GOLD_FIELDS = ("gold_answers", "evidence_turn_ids")


def for_answerer(questions: DataFrame) -> DataFrame:
    return questions.select(*FOR_ANSWERER)


def for_judge(questions: DataFrame) -> DataFrame:
    return questions.select(*FOR_JUDGE)


def check_no_gold(inputs: DataFrame) -> DataFrame:
    """``inputs`` of an answerer; raises if a column of any depth is a gold field."""
    held = [g for g in GOLD_FIELDS if f'"name":"{g}"' in inputs.schema.json().replace(" ", "")]
    if held:
        raise DatasetError(f"gold fields are visible to the answerer: {', '.join(held)}")
    return inputs


def evidence_audit(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """(conversation_id, evidence, found, missing): how many evidence ids are ids of turns."""
    ids = questions.select("conversation_id", F.explode("evidence_turn_ids").alias("id"))
    known = turns.select("conversation_id", "id").distinct().withColumn("known", F.lit(1))
    counts = ids.join(known, ["conversation_id", "id"], "left").groupBy("conversation_id").agg(F.count("*").alias("evidence"), F.count("known").alias("found"))
    return counts.withColumn("missing", F.col("evidence") - F.col("found"))


def json_texts(value: Column) -> Column:
    """``texts`` of a JSON column whose values are plain strings, numbers, nulls or arrays of them; truth values and objects give nothing."""
    parsed = F.try_parse_json(value)
    array = F.try_variant_get(parsed, "$", "array<variant>")
    one = F.coalesce(array, F.array(parsed))

    def plain(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return F.when(F.is_variant_null(v), "None").when(kind == "BOOLEAN", F.lit(None)).when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.try_variant_get(v, "$", "string"))

    return F.filter(F.transform(one, plain), lambda t: t.isNotNull())
