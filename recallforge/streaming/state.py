"""Streams of turns: windows by count, and merges on write, with state by key; results depend on the order of arrival only.

The state of a window is at most its turns; that of a merge the memories of a namespace and type.  There is no watermark,
as no result depends on event time.  A stream gives what the batch operators give for the same order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recallforge.operators.ingest import SAME, Pool

_WINDOWS = "namespace string, window long, full boolean, n_turns long, combined string"


def window_text(turns: list[list[str]]) -> str:
    lines = "\n".join(f"Turn {i} — {actor}: {text}" for i, (actor, text) in enumerate(turns, 1))
    return f"[Multi-turn conversation — {len(turns)} turns]\n{lines}"


class Buffer:
    """The turns of a conversation that no full window has consumed; ``made`` counts the full ones."""

    def __init__(self, size: int, turns: list[list[str]] | None = None, made: int = 0):
        if size < 1:
            raise ValueError("a window has one turn at least")
        self.size, self.turns, self.made = size, turns or [], made

    def push(self, actor: str, text: str) -> tuple[int, bool, list[list[str]]] | None:
        """A full window once there are enough turns; half of them, rounded up, are consumed."""
        self.turns.append([actor, text])
        if len(self.turns) < self.size:
            return None
        out = (self.made, True, self.turns[: self.size])
        self.turns, self.made = self.turns[-(-self.size // 2) :], self.made + 1
        return out

    def flush(self) -> tuple[int, bool, list[list[str]]] | None:
        """What is left, as a window that is not full; the buffer is empty then, so nothing leaks into what follows."""
        out = (self.made, False, self.turns) if self.turns else None
        self.turns, self.made = [], 0
        return out


def stream_windows(turns: DataFrame, size: int = 5, idle: str | None = None) -> DataFrame:
    """Windows of a stream of turns (namespace, seq, actor, text) as they fill up.

    A turn without a text ends its conversation: what is left is given.  With ``idle`` (as "10 minutes") a conversation ends
    as well once nothing came for so long.  Within a micro-batch turns are taken in the order of ``seq``.
    """

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = Buffer(size, *json.loads(state.get[0])) if state.exists else Buffer(size)
        out: list[Any] = []
        if state.hasTimedOut:
            out.append(buffer.flush())
        else:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
            for actor, text in zip(rows["actor"], rows["text"], strict=True):
                out.append(buffer.flush() if text is None else buffer.push(actor, text))
        if buffer.turns or buffer.made:
            state.update((json.dumps([buffer.turns, buffer.made]),))
            if idle is not None:
                state.setTimeoutDuration(idle)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], w, full, len(t), window_text(t)) for w, full, t in filter(None, out)], columns=["namespace", "window", "full", "n_turns", "combined"])

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return turns.groupBy("namespace").applyInPandasWithState(run, _WINDOWS, "buffer string", "append", timeout)


_MERGED = "id string, namespace string, memory_type string, content string, source_event_id string, importance double, confidence double, metadata string, seq long, merged long"


def stream_fold(memories: DataFrame, least: float = SAME) -> DataFrame:
    """New and changed memories of a stream of them (as for ``ingest.fold``), merged into those that came before.

    Append the result to the record log: its replay, where the last version of an id wins, is what the batch fold gives.
    """
    names = [f.split(" ")[0] for f in _MERGED.split(", ")]

    def run(key: tuple[str, str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pool = Pool(least)
        pool.restore(json.loads(state.get[0]) if state.exists else [])
        before = [(r["content"], r["merged"]) for r in pool.rows]
        for row in pd.concat(list(batches)).sort_values(["seq", "content"]).to_dict("records"):
            pool.add({**row, "metadata": json.loads(row["metadata"]) if row["metadata"] else {}, "side_channel": bool(row["side_channel"])})
        state.update((json.dumps(pool.rows, default=str),))
        changed = [r for i, r in enumerate(pool.rows) if i >= len(before) or (r["content"], r["merged"]) != before[i]]
        yield pd.DataFrame([{**{n: r.get(n) for n in names}, "metadata": json.dumps(r["metadata"], sort_keys=True)} for r in changed], columns=names)

    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    rows = memories.select("id", "namespace", "memory_type", "content", "source_event_id", F.col("importance").cast("double").alias("importance"), F.col("confidence").cast("double").alias("confidence"), F.to_json(meta).alias("metadata"), F.col("seq").cast("long").alias("seq"), F.map_contains_key(meta, F.lit("side_channel")).alias("side_channel"))
    out = rows.groupBy("namespace", "memory_type").applyInPandasWithState(run, _MERGED, "pool string", "update", GroupStateTimeout.NoTimeout)
    return out.withColumn("metadata", F.from_json("metadata", "map<string,string>"))
