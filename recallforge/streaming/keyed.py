"""Merges and windows over streams with state by key that is read and written by the row.

The state of a key is a table of its own in the state store: a batch reads the memories that its rows may match, and
writes those that it changes; what it does not touch is neither read nor written.  It needs the RocksDB state store, which
``stateful`` sets for the session.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recallforge.functions.text import merged, stemmed
from recallforge.operators.ingest import SAME, ascii_lower
from recallforge.streaming.state import window_text

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MEMORY = "id string, content string, source_event_id string, importance double, confidence double, metadata string, seq long, merged long, side_channel boolean"
_FOLDED = "id string, namespace string, memory_type string, content string, source_event_id string, importance double, confidence double, metadata string, seq long, merged long"
_WINDOWS = "namespace string, window long, full boolean, n_turns long, combined string"


def stateful(df: DataFrame) -> DataFrame:
    """Sets the state store of the stream's session to the one that states by key need."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df


def prefix(tokens: set[str], least: float) -> list[str]:
    """Of a set, the tokens of which any set that overlaps by ``least`` has one among its own; long words come first, as they are rare."""
    order = sorted(tokens, key=lambda t: (-len(t), t))
    return order[: len(order) - math.ceil(least * len(order) - 1e-9) + 1] if order else []


class Folding(StatefulProcessor):
    """Memories of a (namespace, memory_type) by place, found by text and by the first tokens of their sets."""

    def __init__(self, least: float):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.rows = handle.getMapState("rows", "place long", _MEMORY)
        self.by_token = handle.getMapState("by_token", "token string", "places array<long>")
        self.by_text = handle.getMapState("by_text", "text string", "places array<long>")

    def close(self) -> None:
        pass

    def _index(self, state: Any, key: str, place: int) -> None:
        held = list(state.getValue((key,))[0]) if state.containsKey((key,)) else []
        if place not in held:
            state.updateValue((key,), ([*held, place],))

    def _find(self, content: str, held: dict[int, dict]) -> int | None:
        low, own = ascii_lower(content), set(stemmed(content))
        near = set(self.by_text.getValue((low,))[0]) if self.by_text.containsKey((low,)) else set()
        for t in prefix(own, self.least):
            if self.by_token.containsKey((t,)):
                near.update(self.by_token.getValue((t,))[0])
        for place in sorted(int(p) for p in near):
            theirs = self._row(place, held)["content"]
            other = set(stemmed(theirs))
            if ascii_lower(theirs) == low or own and other and len(own & other) >= self.least * len(own | other):
                return place
        return None

    def _row(self, place: int, held: dict[int, dict]) -> dict:
        if place not in held:
            names = [f.split(" ")[0] for f in _MEMORY.split(", ")]
            held[place] = dict(zip(names, self.rows.getValue((place,)), strict=True))
        return held[place]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n = int(self.count.get()[0]) if self.count.exists() else 0
        held: dict[int, dict] = {}  # memories read in this batch
        changed: dict[int, None] = {}
        for row in pd.concat(list(rows)).sort_values(["seq", "content"]).to_dict("records"):
            new = {**row, "metadata": row["metadata"] or "{}", "side_channel": bool(row["side_channel"]), "merged": 1}
            place = None if new["side_channel"] else self._find(new["content"], held)
            if place is None:
                place, n = n, n + 1
                held[place] = new
            else:
                old = self._row(place, held)
                both = {**json.loads(old["metadata"]), **json.loads(new["metadata"])}
                held[place] = old | {"content": merged(old["content"], new["content"]), "importance": max(old["importance"], new["importance"]), "confidence": max(old["confidence"], new["confidence"]), "metadata": json.dumps(both, sort_keys=True), "merged": old["merged"] + 1}
            if not new["side_channel"]:
                self._index(self.by_text, ascii_lower(held[place]["content"]), place)
                for t in prefix(set(stemmed(held[place]["content"])), self.least):
                    self._index(self.by_token, t, place)
            changed[place] = None
        names = [f.split(" ")[0] for f in _MEMORY.split(", ")]
        for place in changed:
            r = held[place]
            self.rows.updateValue((place,), (r["id"], r["content"], r["source_event_id"], float(r["importance"]), float(r["confidence"]), r["metadata"], int(r["seq"]), int(r["merged"]), bool(r["side_channel"])))
        self.count.update((n,))
        out = pd.DataFrame([{c: held[p][c] for c in names} for p in changed], columns=names).drop(columns="side_channel")
        out.insert(1, "namespace", key[0])
        out.insert(2, "memory_type", key[1])
        yield out


def fold(memories: DataFrame, least: float = SAME) -> DataFrame:
    """New and changed memories of a stream of them (as for ``ingest.fold``), merged into those that came before.

    Append the result to the record log: its replay, where the last version of an id wins, is what the batch fold gives for
    the same order.  Within a micro-batch rows are taken in the order of ``seq``.  A batch costs what its rows and the
    memories near them cost, however many the key has.
    """
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    rows = memories.select("id", "namespace", "memory_type", "content", "source_event_id", F.col("importance").cast("double").alias("importance"), F.col("confidence").cast("double").alias("confidence"), F.to_json(meta).alias("metadata"), F.col("seq").cast("long").alias("seq"), F.map_contains_key(meta, F.lit("side_channel")).alias("side_channel"))
    out = stateful(rows).groupBy("namespace", "memory_type").transformWithStateInPandas(Folding(least), _FOLDED, "Update", "None")
    return out.withColumn("metadata", F.from_json("metadata", "map<string,string>"))


class Windowing(StatefulProcessor):
    """The turns of a conversation that no full window has consumed, at most a window's; a timer for conversations that stop."""

    def __init__(self, size: int, idle_ms: int | None):
        self.size, self.idle_ms = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "actor string, text string")
        self.made = handle.getValueState("made", "n long")

    def close(self) -> None:
        pass

    def _given(self, key: Any, windows: list[tuple[int, bool, list]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], w, full, len(t), window_text(t)) for w, full, t in windows], columns=[f.split(" ")[0] for f in _WINDOWS.split(", ")])

    def _ended(self, turns: list, made: int) -> list[tuple[int, bool, list]]:
        return [(made, False, turns)] if turns else []

    def _timed(self, at: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        turns = [list(t) for t in self.turns.get()] if self.turns.exists() else []
        made, out = int(self.made.get()[0]) if self.made.exists() else 0, []
        given = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for actor, text in zip(given["actor"], given["text"], strict=True):
            if text is None:
                out += self._ended(turns, made)
                turns, made = [], 0
                continue
            turns.append([actor, text])
            if len(turns) == self.size:
                out.append((made, True, turns))
                turns, made = turns[-(-self.size // 2) :], made + 1
        if turns or made:
            self.turns.put([tuple(t) for t in turns])
            self.made.update((made,))
        else:
            self.turns.clear()
            self.made.clear()
        if self.idle_ms is not None:
            self._timed(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms if turns or made else None)
        yield self._given(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        turns = [list(t) for t in self.turns.get()] if self.turns.exists() else []
        out = self._ended(turns, int(self.made.get()[0]) if self.made.exists() else 0)
        self.turns.clear()
        self.made.clear()
        yield self._given(key, out)


def windows(turns: DataFrame, size: int = 5, idle_ms: int | None = None) -> DataFrame:
    """Windows of a stream of turns (namespace, seq, actor, text) as they fill up, as ``ingest.windows`` gives them.

    A turn without a text ends its conversation: what is left is given.  With ``idle_ms`` a conversation ends as well once
    nothing came for so long.  Within a micro-batch turns are taken in the order of ``seq``.
    """
    if size < 1:
        raise ValueError("a window has one turn at least")
    keyed = stateful(turns.select("namespace", "seq", "actor", "text")).groupBy("namespace")
    return keyed.transformWithStateInPandas(Windowing(size, idle_ms), _WINDOWS, "Append", "None" if idle_ms is None else "ProcessingTime")


def gap_sessions(turns: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(namespace, started, ended, n_turns, transcript): turns (namespace, time, seq, actor, text) with less than ``gap`` between each other.

    A session ends ``gap`` after its last turn.  The same plan serves tables and streams.  On a stream ``late`` (as "10
    minutes") is how much later than the latest one a turn may come: turns up to that are in their sessions in whatever
    order they come, later ones are dropped, and a session is given once nothing can join it.  Turns without a time are in none.
    """
    rows = turns.filter("time is not null")
    if late is not None:
        rows = rows.withWatermark("time", late)
    line = F.struct("time", "seq", F.concat_ws(": ", "actor", "text").alias("line"))
    held = rows.groupBy("namespace", F.session_window("time", gap).alias("s")).agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(line)).alias("lines"))
    return held.select("namespace", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("transcript"))
