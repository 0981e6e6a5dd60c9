"""Memories out of a model's answers: tolerant JSON, typed facts, source keywords; rules where the model fails."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.operators.ingest import candidates
from recallforge.providers import LlmError, LlmProvider, Message, Request
from recallforge.schema import MEMORY_TYPES, stable_id

# Types that models use and what they are, phrases and identity words for keywords, words that say little,
# defaults of importance and confidence, and the number of keywords.
TYPE_NAMES = {"preference": "reflection", "event": "episodic", "relationship": "semantic", "attribute": "semantic", "time": "semantic", "quantity": "semantic"}
PHRASES = ("last year", "last month", "last week", "yesterday", "tomorrow", "next week", "next month", "two weeks", "support group", "mental health", "trans community")
IDENTITY = ("transgender", "lgbtq")
LOW_VALUE = frozenset("the and for that this with you your was were are but not have has had all really very just about".split())
IMPORTANCE, CONFIDENCE, MOST_KEYWORDS = 0.65, 0.70, 14

#: What a model is asked for; our own wording.
SYSTEM = (
    'You read one message of a conversation and list what is worth remembering. Answer with one JSON object, {"facts": [...]}, and nothing else. '
    "A fact is a whole sentence that can be understood alone: it names people instead of using pronouns, keeps the exact terms of the message, states feelings "
    "that were expressed, and turns relative dates into dates by the observation date. One statement a fact, from every turn; never add what was not said. "
    'Only a message without content has no facts: {"facts": []}.'
)


def without_fences(text: str) -> str:
    """Without a Markdown code fence around it."""
    text = text.strip()
    for opening in ("```json", "```"):
        if text.startswith(opening):
            text = text[len(opening) :]
            break
    return text.removesuffix("```").strip()


def between(text: str, opening: str, closing: str) -> str | None:
    """From the first ``opening`` to the last ``closing``."""
    a, b = text.find(opening), text.rfind(closing)
    return text[a : b + 1] if 0 <= a < b else None


def _read(text: str | None) -> Any:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def items_of(value: Any) -> list:
    """The memories in a whole JSON value: of facts, memories, memory, of an array, or the object itself."""
    if isinstance(value, dict):
        if isinstance(value.get("facts"), list):
            plain = [{"fact": f.strip()} if isinstance(f, str) else f for f in value["facts"]]
            return [f for f in plain if isinstance(f, dict) and f != {"fact": ""}]
        for name in ("memories", "memory"):
            if isinstance(value.get(name), list):
                return value[name]
        return [value] if any(k in value for k in ("content", "fact", "memory")) else []
    return value if isinstance(value, list) else []


_STRING = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)', re.S)


def outside_strings(text: str) -> Iterator[tuple[int, str]]:
    """The characters that are in no JSON string, with their places; a string that is not closed reaches to the end."""
    at = 0
    while at < len(text):
        if text[at] == '"':
            at = _STRING.match(text, at).end()
        else:
            yield at, text[at]
            at += 1


def whole_objects(text: str) -> list[str]:
    """The outermost {...} of an array's inside, until it ends or the text does."""
    out, start, depth = [], 0, 0
    for i, c in outside_strings(text):
        if c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
        elif c == "]" and depth == 0:
            break
    return out


def repaired(text: str) -> str | None:
    """A cut JSON text with its string, braces and brackets closed; null if that gives no array and no object with content."""
    text = text.strip()
    open_ = {"{": 0, "[": 0}
    for _, c in outside_strings(text):
        if c in open_:
            open_[c] += 1
        elif c in "}]":
            kind = "{" if c == "}" else "["
            open_[kind] = max(0, open_[kind] - 1)
    last = None
    for last in _STRING.finditer(text):
        pass
    in_string = last is not None and last.end() == len(text) and not re.fullmatch(r'"(?:[^"\\]|\\.)*"', last[0], re.S)
    closed = (text + '"' if in_string else text).rstrip(", \n\t\r") + "}" * open_["{"] + "]" * open_["["]
    value = _read(closed)
    return closed if isinstance(value, list) or (isinstance(value, dict) and value) else None


def memory_items(response: str) -> list:
    """The memories in a model's answer, by ever more lenient readings; raises if there are none."""
    text = without_fences(response)
    if not text:
        raise LlmError("an empty answer")
    array = between(text, "[", "]")
    for reading in (lambda: text, lambda: between(text, "{", "}"), lambda: array, lambda: array and repaired(array)):
        if found := items_of(_read(reading())):
            return found
    found = [x for line in text.splitlines() for x in items_of(_read(line.strip()))]
    at = text.find('"memories"')
    inside = text.find("[", at) if at >= 0 else -1
    if inside >= 0:
        found += [v for v in map(_read, whole_objects(text[inside + 1 :])) if v is not None]
    found = found or items_of(_read(repaired(text)))
    if not found:
        raise LlmError("an answer without JSON memories")
    return found


def keywords(actor: str, text: str, timestamp: str | None = None) -> list[str]:
    """Up to 14 words that a memory can be found by: actor, time, known phrases, then words of three bytes that say something."""
    low = text.lower()
    first = [actor, timestamp or "", *(p for p in PHRASES if p in low), *(["identity"] if any(w in low for w in IDENTITY) else [])]
    out: dict[str, str] = {}

    def key(word: str) -> str:  # case of ASCII letters only
        return "".join(c.lower() if c.isascii() else c for c in word)

    for w in first:
        if w.strip():
            out.setdefault(key(w.strip()), w.strip())
    for w in re.findall(r"(?:[^\W_]|['-])+", text):
        if len(w.encode()) >= 3 and w.lower() not in LOW_VALUE:
            out.setdefault(key(w), w)
            if len(out) >= MOST_KEYWORDS:
                break
    return list(out.values())


def _strings(value: Any) -> list[str]:
    return [v.strip() for v in value if isinstance(v, str) and v.strip()] if isinstance(value, list) else []


def _number(value: Any, other: float) -> float:
    return min(max(float(value), 0.0), 1.0) if isinstance(value, (int, float)) and not isinstance(value, bool) else other


def memory_of(item: Any, event: dict) -> dict | None:
    """The memory that an item of an answer stands for; null without a content."""
    item = item.get("memory", item) if isinstance(item, dict) else item
    if not isinstance(item, dict):
        return None
    content = next((item[k] for k in ("content", "text", "fact") if k in item), None)
    if not isinstance(content, str) or not content.strip():
        return None
    kind = item.get("type")
    kind = TYPE_NAMES.get(kind, kind) if isinstance(kind, str) else "semantic"
    found = _strings(item.get("source_keywords")) or keywords(event["actor"], event["text"], event.get("timestamp"))
    meta = {"memory_kind": "llm_fact", "speaker": event["actor"]}
    meta |= {k: item[k].strip() for k in ("subject", "relation", "object", "operation") if isinstance(item.get(k), str)}
    held = [*_strings(item.get("entities")), *found]
    meta |= {k: "\n".join(v) for k, v in (("entities", held), ("source_keywords", found)) if v}
    return {
        "namespace": event["namespace"], "memory_type": kind if kind in MEMORY_TYPES else "episodic", "content": content.strip(), "source_event_id": event["event_id"],
        "importance": _number(item.get("importance"), IMPORTANCE), "confidence": _number(item.get("confidence"), CONFIDENCE), "metadata": meta,
    }


def request_for(event: dict, max_tokens: int = 16384) -> Request:
    time = event.get("timestamp") or ""
    return Request([Message("system", SYSTEM), Message("user", f"Role: {event['actor']}\nContent: {event['text']}\nObservation Date: {time}")], max_tokens=max_tokens, prompt_version="facts-1")


def extracted(event: dict, ask: Callable[[Request], str], tries: int = 3) -> list[dict] | None:
    """The memories of an event by a model; null if it fails ``tries`` times.  An answer {"facts": []} means that there are none."""
    for _ in range(tries):
        try:
            response = ask(request_for(event))
            if _read(without_fences(response)) == {"facts": []}:
                return []
            return [m for m in (memory_of(i, event) for i in memory_items(response)) if m]
        except LlmError:
            continue
    return None


_FIELDS = "namespace string, event_id string, pos int, memory_type string, content string, importance double, confidence double, metadata map<string,string>, failed boolean"


def llm_candidates(turns: DataFrame, provider: LlmProvider, tries: int = 3) -> DataFrame:
    """(namespace, event_id, pos, memory_type, content, importance, confidence, metadata) of turns, by a model, else by the rules."""
    time = F.col("timestamp") if "timestamp" in turns.columns else F.lit(None).cast("string")
    rows = turns.select("namespace", "event_id", F.coalesce("actor", F.lit("user")).alias("actor"), F.coalesce("text", F.lit("")).alias("text"), time.alias("timestamp"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in _FIELDS.split(", ")]
        for batch in batches:
            out: list[dict] = []
            for event in batch.to_dict("records"):
                got = extracted(event, provider.complete, tries)
                base = {"namespace": event["namespace"], "event_id": event["event_id"]}
                if got is None:
                    out.append({**base, "failed": True})
                for pos, m in enumerate(got or ()):
                    out.append({**base, **m, "pos": pos, "failed": False})
            frame = pd.DataFrame(out, columns=names, dtype=object)
            yield frame.where(frame.notna(), None)

    found = rows.mapInPandas(run, _FIELDS)
    missed = rows.join(found.filter("failed").select("namespace", "event_id"), ["namespace", "event_id"], "left_semi")
    ruled = candidates(missed).withColumn("metadata", F.create_map().cast("map<string,string>"))
    columns = ["namespace", "event_id", "pos", "memory_type", "content", "importance", "confidence", "metadata"]
    return found.filter("not failed").select(*columns).unionByName(ruled.select(*columns))


def with_ids(found: DataFrame) -> DataFrame:
    """Candidates as memories with ids of their own."""
    return found.select(stable_id("mem", F.col("event_id"), F.col("pos"), F.col("content")).alias("id"), "namespace", "memory_type", "content", F.col("event_id").alias("source_event_id"), "importance", "confidence", *(["metadata"] if "metadata" in found.columns else []))

