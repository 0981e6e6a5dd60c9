"""Rerankers of candidate lists: by bonuses, by a model, by diversity; and alternative wordings of questions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.functions.text import overlap
from recallforge.operators.answer import any_in
from recallforge.providers import LlmError, LlmProvider, Message, Request

# Bonuses by words of the question and of the memory, months and years of a date, and how many are looked at.
TOPICS = (
    (0.90, ("field", "fields", "education", "educaton", "degree"), ("psychology", "counseling", "certification", "mental health", "education")),
    (0.85, ("research",), ("research", "researching", "adoption agenc")), (0.75, ("identity",), ("transgender", "trans woman", "trans community")),
    (0.70, ("relationship status",), ("single", "partner", "relationship")), (0.30, ("where", "location", "live", "from"), (" in ", " at ", " from ", " moved ", " lives ")),
)
TIME_ASKED = ("when", "what date", "what year", "how long")
TIME_TOLD = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "2022", "2023")
POOL, KEPT, MOST_BONUS = 50, 10, 1.5
NUDGE = {"verbatim_turn": 0.03, "llm_fact": 0.03, "observation": 0.03, "verbatim_session": -0.04}

Rerank = Callable[[str, list[dict]], list[dict]]


def bonus(question: str, packet: dict) -> float:
    """What a memory (content, metadata) gains for a question by topic, time, place and the names in its metadata."""
    q, content, meta = question.lower(), packet["content"].lower(), dict(packet.get("metadata") or ())
    total = sum(points for points, asked, told in TOPICS if any_in(q, asked) and any_in(content, told))
    if any_in(q, TIME_ASKED):
        total += 0.2 * ("event_time" in meta) + 0.2 * any_in(content, TIME_TOLD)
    total += 0.15 * sum(len(v.encode()) >= 3 and v in q for v in (meta[k].lower() for k in ("subject", "object", "relation", "speaker") if k in meta))
    return min(total, MOST_BONUS)


def with_reason(packet: dict, reason: str) -> dict:
    return {**packet, "reasons": [*(packet.get("reasons") or ()), reason]}


def by_bonus(question: str, candidates: list[dict], pool: int = POOL, kept: int = KEPT) -> list[dict]:
    """The first ``pool`` by score and bonus: of the best ``kept`` the first of every source, then the others, then the rest."""
    scored = [(packet["score"] + bonus(question, packet), packet) for packet in candidates[:pool]]
    ranked = [p for _, p in sorted(scored, key=lambda x: -x[0])]
    sources: set[str] = set()
    first: dict[str, dict] = {}
    for p in ranked[:kept]:
        source = p.get("source_event_id")
        if source is None or source not in sources:
            first.setdefault(p["id"], with_reason(p, "heuristic_rerank"))
            sources.add(source)
    rest = {p["id"]: p for p in reversed([*ranked, *candidates[pool:]]) if p["id"] not in first}
    return [*first.values(), *reversed(rest.values())]


def by_nudge(question: str, candidates: list[dict]) -> list[dict]:
    """A diagnostic order: small bonuses by kind, form, time and counts; the first of every source before repeated ones."""
    q = question.lower()

    def plus(p: dict) -> float:
        content, meta = p["content"].lower(), dict(p.get("metadata") or ())
        total = NUDGE.get(meta.get("memory_kind", ""), 0.0) - 0.2 * (content.rstrip().endswith("?") or "guess what" in content)
        total += 0.06 * (any_in(q, ("when", "what date", "what year")) and ("event_time" in meta or any_in(content, ("last ", "yesterday", "friday", "sunday", "2022", "2023"))))
        total += 0.08 * (any_in(q, ("how many", "times")) and any_in(content, (" once ", " twice ", " two ", " 2 ", "second")))
        return total + 0.02 * (overlap(q, content) > 0)

    moved = []
    for rank, p in enumerate(candidates):
        extra = plus(p)
        moved.append((with_reason(p, "answer_rerank") if extra else p) | {"score": p["score"] + extra - 0.0001 * rank})
    return diversified(sorted(moved, key=lambda p: -p["score"]))


def diversified(candidates: list[dict]) -> list[dict]:
    """The first of every source, then those of sources that were there already."""
    seen: set[str] = set()
    again = []
    for p in candidates:
        source = p.get("source_event_id")
        again.append(source is not None and source in seen)
        seen.add(source)
    return [p for wanted in (False, True) for p, a in zip(candidates, again, strict=True) if a is wanted]


# ---- by a model


def cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most] + "..."


def one_line(text: str, most: int = 160) -> str:
    return cut(" ".join(text.split()), most)


def rerank_prompt(question: str, candidates: list[dict], kept: int) -> str:
    items = "\n\n".join(f"{i}. ID: {p['id']}\nContent: {cut(p['content'], 1200)}" for i, p in enumerate(candidates, 1))
    return f'Question:\n{question}\n\nName the {kept} memories that answer it best. Give only this JSON: {{"ids": ["memory_id"]}}\n\nMemories:\n{items}\n'


def _ids(items: Any, known: list[str]) -> list[str]:
    out = []
    for item in items if isinstance(items, list) else ():
        if isinstance(item, dict):
            item = next((item[k] for k in ("id", "memory_id") if isinstance(item.get(k), str)), None)
        elif isinstance(item, int) and not isinstance(item, bool):
            item = known[item - 1] if 1 <= item <= len(known) else None
        if isinstance(item, str) and item.strip():
            out.append(item.strip())
    return out


def chosen_ids(response: str, known: list[str]) -> list[str]:
    """The ids that a model names: in JSON as ids, objects or places from 1, else where they stand in its text."""
    try:
        value = json.loads(response)
    except ValueError:
        value = None
    lists = [value] if isinstance(value, list) else [value[k] for k in ("ids", "memory_ids", "ranked_ids", "ranking", "selected") if k in value] if isinstance(value, dict) else []
    if found := next((ids for x in lists if (ids := _ids(x, known))), None):
        return found
    return [i for at, i in sorted((response.find(i), i) for i in known) if at >= 0]


def reordered(candidates: list[dict], ids: list[str], kept: int = KEPT) -> list[dict]:
    """The named candidates, ``kept`` at most, then all others in their order."""
    by_id: dict[str, dict] = {}
    for p in candidates:
        by_id.setdefault(p["id"], p)
    first = [i for i in dict.fromkeys(ids) if i in by_id][:kept]
    return [*(with_reason(by_id[i], "llm_rerank") for i in first), *(p for i, p in by_id.items() if i not in first)]


def by_model(provider: LlmProvider, pool: int = POOL, kept: int = KEPT, max_tokens: int = 256) -> Rerank:
    """Reranks by asking a model; its errors end the job."""

    def rerank(question: str, candidates: list[dict]) -> list[dict]:
        if not candidates:
            return candidates
        some = candidates[:pool]
        text = rerank_prompt(question, some, min(kept, len(some)))
        request = Request([Message("system", "You rank search results. Answer with JSON only."), Message("user", text)], model=provider.metadata().get("model", ""), max_tokens=max_tokens, prompt_version="rerank-1")
        return reordered(candidates, chosen_ids(provider.complete(request), [p["id"] for p in some]), kept)

    return rerank


#: Rerankers by name; others can be added.
RERANKERS: dict[str, Rerank] = {"heuristic": by_bonus, "nudge": by_nudge, "none": lambda _, candidates: candidates}


def reranked(rows: DataFrame, rerank: str | Rerank = "heuristic", text_col: str = "text", candidates_col: str = "candidates") -> DataFrame:
    """``rows`` with their array of candidates (id, content, metadata, score, source_event_id, reasons) in another order; a map without a shuffle."""
    call, schema = RERANKERS[rerank] if isinstance(rerank, str) else rerank, rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(candidates_col)
            out = [call(q or "", c or []) for q, c in zip(batch.column(text_col).to_pylist(), batch.column(at).to_pylist(), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return rows.mapInArrow(run, schema)


# ---- other wordings of a question


def variants(response: str) -> list[str]:
    """Up to three wordings of more than three bytes in a model's answer, an array or {"variants": [...]}."""
    try:
        value = json.loads(response.strip())
    except ValueError as e:
        raise LlmError(f"variants can't be read: {e}") from e
    items = value.get("variants") if isinstance(value, dict) else value
    if not isinstance(items, list):
        raise LlmError("variants are no array")
    found = [v.strip() for v in items if isinstance(v, str) and len(v.strip().encode()) > 3][:3]
    if not found:
        raise LlmError("no variants")
    return found


def expanded(queries: DataFrame, provider: LlmProvider) -> DataFrame:
    """(query_id, variant, text) of queries (query_id, text): the question as variant 0 and a model's wordings; on errors the question alone."""

    def ask(text: str) -> list[str]:
        system = "Give three other wordings of the question, each a whole question in other words. Answer with a JSON array of strings only."
        try:
            return [text, *variants(provider.complete(Request([Message("system", system), Message("user", f"Question: {text}")], model=provider.metadata().get("model", ""), temperature=0.3, max_tokens=256, prompt_version="variants-1")))]
        except LlmError:
            return [text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ask(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(found, pa.list_(pa.string()))], names=["query_id", "texts"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "text").mapInArrow(run, f"query_id {kind}, texts array<string>").select("query_id", F.posexplode("texts").alias("variant", "text"))
