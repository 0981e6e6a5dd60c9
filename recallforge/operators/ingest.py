"""From conversation turns to memories: sentences, rules, summaries, merges on write, windows, verbatim records."""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallforge.functions.entities import enrich
from recallforge.functions.text import classify, merged, sentences, should_keep, stemmed, summary
from recallforge.operators import observe
from recallforge.operators.merge import merge_components, replayed
from recallforge.schema import stable_id
from recallforge.sources.shared import Scratch, materialize

# Importance and confidence of summaries, prefixed and plain verbatim turns, and sessions; the overlap from
# which two memories are one.
SUMMARY, PREFIXED, PLAIN, SESSION = (0.35, 0.55), (0.45, 0.7), (0.5, 0.75), (0.2, 0.45)
SAME = 0.72
#: The most memories, and bytes of their contents, of a namespace and type that are replayed in one place.
APART, APART_BYTES = 4096, 8 << 20


def candidates(turns: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(namespace, event_id, pos, content, memory_type, importance, confidence, and ``keep``): kept sentences of turns (namespace, event_id,
    actor, text), once an event whatever their case; of a turn of eight words without any, a summary.

    All of it is within a row, so nothing is shuffled.
    """
    said = F.transform(sentences(F.col("text")), lambda s, i: F.struct(i.alias("pos"), s.alias("content"), classify(F.lower(s)).alias("c")))
    kept = F.filter(said, lambda x: should_keep(F.lower(x["content"]), x["c"]["memory_type"]))
    rows = turns.select("namespace", "event_id", *keep, "actor", "text", kept.alias("kept")).withColumn("low", F.transform("kept", lambda x: F.lower(x["content"])))
    first = F.filter("kept", lambda x, i: F.array_position("low", F.lower(x["content"])) == i + 1)
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    told = F.struct(F.lit(0).alias("pos"), summary(F.col("actor"), F.col("text")).alias("content"), F.struct(F.lit("episodic").alias("memory_type"), F.lit(SUMMARY[0]).alias("importance"), F.lit(SUMMARY[1]).alias("confidence")).alias("c"))
    all_ = F.when(F.size("kept") > 0, first).when(words >= 8, F.array(told)).otherwise(first)
    return rows.select("namespace", "event_id", *keep, F.explode(all_).alias("x")).select("namespace", "event_id", *keep, "x.pos", "x.content", "x.c.*")


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


class Pool:
    """Memories of one namespace and type in the order in which they came, found by their tokens."""

    def __init__(self, least: float):
        self.least, self.rows, self.tokens = least, [], []
        self.made: list[set[str]] = []  # sets of tokens that merging has made
        self.by_token, self.by_text = defaultdict(list), {}

    def _index(self, i: int, new: set[str]) -> None:
        for t in new:
            self.by_token[t].append(i)
        self.by_text.setdefault(ascii_lower(self.rows[i]["content"]), []).append(i)

    def restore(self, rows: list[dict]) -> None:
        """Takes up memories of before, as they are."""
        for row in rows:
            self.rows.append(dict(row))
            self.tokens.append(set() if row.get("side_channel") else set(stemmed(row["content"])))
            if not row.get("side_channel"):
                self._index(len(self.rows) - 1, self.tokens[-1])

    def find(self, content: str) -> int | None:
        """The first memory that equals the content but for case, or whose token set overlaps with its by ``least``."""
        own = set(stemmed(content))
        found = [i for i in self.by_text.get(ascii_lower(content), ()) if ascii_lower(self.rows[i]["content"]) == ascii_lower(content)]
        # a set that overlaps by ``least`` has one of any so many tokens: the rarest ones are looked up
        n = len(own) - math.ceil(self.least * len(own) - 1e-9) + 1
        near = {i for t in sorted(own, key=lambda t: (len(self.by_token[t]), t))[:n] for i in self.by_token[t]}
        found += [i for i in near if self.tokens[i] and len(own & self.tokens[i]) >= self.least * len(own | self.tokens[i])]
        return min(found, default=None)

    def add(self, row: dict) -> None:
        i = None if row.get("side_channel") else self.find(row["content"])
        if i is None:
            self.rows.append({**row, "merged": 1})
            self.tokens.append(set() if row.get("side_channel") else set(stemmed(row["content"])))
            if not row.get("side_channel"):
                self._index(len(self.rows) - 1, self.tokens[-1])
            return
        held = self.rows[i]
        held |= {"content": merged(held["content"], row["content"]), "importance": max(held["importance"], row["importance"]), "confidence": max(held["confidence"], row["confidence"]), "merged": held["merged"] + 1}
        held["metadata"] = {**(dict(held.get("metadata") or {})), **(dict(row.get("metadata") or {}))}
        tokens = set(stemmed(held["content"]))
        if tokens != self.tokens[i]:
            self.made.append(tokens)
        new, self.tokens[i] = tokens - self.tokens[i], tokens
        self._index(i, new)


_FOLDED = "id string, namespace string, memory_type string, content string, source_event_id string, importance double, confidence double, metadata map<string,string>, seq long, merged long"


def fold(memories: DataFrame, least: float = SAME) -> DataFrame:
    """Merge on write, in the order of ``seq``, within (namespace, memory_type); adds ``merged``, how many rows a memory is of.

    A row joins the first memory that equals it but for case or whose token sets overlap by ``least``: contents are joined,
    importance and confidence take the larger value, its metadata win; id, source and place stay those of the first row.
    Side-channel rows (``metadata.side_channel``) merge with nothing.  Where a namespace and type has few rows, they are
    replayed in one place.  In larger ones the order matters among rows that can meet only: see ``merge``, which replays these
    in order and all others in parallel, and writes its result.
    """
    have = memories.columns
    meta = F.col("metadata") if "metadata" in have else F.create_map().cast("map<string,string>")
    other = {"id": stable_id("mem", F.col("namespace"), F.col("memory_type"), F.col("seq"), F.col("content")), "source_event_id": F.lit(None).cast("string")}
    rows = memories.select(
        *[(F.col(c) if c in have else other[c]).alias(c) for c in ("id", "namespace", "memory_type", "content", "source_event_id")],
        F.col("importance").cast("double").alias("importance"), F.col("confidence").cast("double").alias("confidence"), meta.alias("metadata"), F.col("seq").cast("long").alias("seq"),
        F.coalesce(F.map_contains_key(meta, F.lit("side_channel")), F.lit(False)).alias("side_channel"),
    )
    names, space = [f.split(" ")[0] for f in _FOLDED.split(", ")], ["namespace", "memory_type"]
    spark = memories.sparkSession
    sizes = rows.groupBy(*space).agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))
    # there is one for each APART memories at most
    crowded = [tuple(r) for r in sizes.filter(f"n > {APART} or bytes > {APART_BYTES}").select(*space).collect()]
    if not crowded:
        return replayed(rows, space, Pool, least, _FOLDED).select(*names)
    large = spark.createDataFrame(crowded, "namespace string, memory_type string")
    with Scratch(spark) as scratch:
        rows = scratch.table(rows, "rows")  # so they are made once
        same = [rows[c].eqNullSafe(large[c]) for c in space]
        given = rows.join(F.broadcast(large), same, "left_semi")
        alone = given.filter("side_channel").drop("side_channel").withColumn("merged", F.lit(1).cast("long"))
        merged = merge_components(given.filter("not side_channel").drop("side_channel"), least, Pool, _FOLDED, scratch)
        small = replayed(rows.join(F.broadcast(large), same, "left_anti"), space, Pool, least, _FOLDED)
        return materialize(merged.filter("state is null").select(*names).unionByName(alone.select(*names)).unionByName(small.select(*names)), "folded")


def windows(turns: DataFrame, size: int = 5) -> DataFrame:
    """Sliding windows over each namespace's turns in the order of ``seq``: full ones, and the flushed tail.

    Full window j covers [j*s, j*s + size) with s the half of ``size``, rounded up; the tail what is left from the last
    such start on.  Turns join the few windows they fall in by arithmetic, so no pair is tested.
    """
    if size < 1:
        raise ValueError("a window has one turn at least")
    s = -(-size // 2)
    w = Window.partitionBy("namespace")
    t = turns.withColumn("i", F.row_number().over(w.orderBy("seq")) - 1).withColumn("n", F.count("*").over(w))
    full = F.when(F.col("n") < size, 0).otherwise(F.floor((F.col("n") - size) / s) + 1)
    t = t.withColumn("m", full.cast("long"))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / s)).cast("long")
    last = F.floor(F.col("i") / s).cast("long")
    t = t.withColumn("j", F.explode(F.sequence(F.least(first, "m"), F.greatest(F.least(last, F.col("m")), F.least(first, "m")))))
    t = t.filter((F.col("j") < F.col("m")) & (F.col("i") >= F.col("j") * s) & (F.col("i") < F.col("j") * s + size) | (F.col("j") == F.col("m")) & (F.col("i") >= F.col("m") * s))
    line = F.struct("i", "actor", "text")
    return t.groupBy("namespace", "j", (F.col("j") < F.col("m")).alias("full")).agg(F.array_sort(F.collect_list(line)).alias("turns")).select(
        "namespace", F.col("j").alias("window"), "full", F.size("turns").cast("long").alias("n_turns"), combined(F.col("turns")).alias("combined"),
    )


def combined(turns: Column) -> Column:
    """The text of a window of turns (actor, text)."""
    lines = F.transform(turns, lambda x, k: F.concat(F.lit("Turn "), (k + 1).cast("string"), F.lit(" — "), x["actor"], F.lit(": "), x["text"]))
    return F.concat(F.lit("[Multi-turn conversation — "), F.size(turns).cast("string"), F.lit(" turns]\n"), F.array_join(lines, "\n"))


def buffered_candidates(turns: DataFrame, size: int = 5) -> DataFrame:
    """``candidates`` of windows of turns instead of single turns; a window is an event of the actor multi-turn."""
    w = windows(turns, size)
    return candidates(w.select("namespace", stable_id("win", F.col("namespace"), F.col("window"), F.col("full")).alias("event_id"), F.lit("multi-turn").alias("actor"), F.col("combined").alias("text")))


def transcripts(turns: DataFrame) -> DataFrame:
    """(namespace, n_turns, transcript) of namespaces with two turns or more."""
    lines = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(": ", "actor", "text").alias("line"))))
    out = turns.groupBy("namespace").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))
    return out.filter("n_turns >= 2")


def neighbours(turns: DataFrame, radius: int = 1) -> DataFrame:
    """(namespace, seq, near, distance, score) of turns within ``radius``: by offsets, not by a range join."""
    near = turns.select("namespace", "seq", F.explode(F.sequence(F.col("seq") - radius, F.col("seq") + radius)).alias("near"))
    there = turns.select("namespace", F.col("seq").alias("near"))
    distance = F.abs(F.col("near") - F.col("seq"))
    return near.join(there, ["namespace", "near"]).select("namespace", "seq", "near", distance.alias("distance"), (0.3 / F.greatest(distance, F.lit(1))).alias("score"))


# ---- whole datasets: turns (conversation_id, turn_index, id, speaker, text, timestamp) as memories in writing order


def _meta(pairs: dict[str, Column], time: Column) -> Column:
    base = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    return F.when(time.isNotNull(), F.map_concat(base, F.create_map(F.lit("event_time"), time))).otherwise(base)


def _place(step: int, pos: Column | int = 0) -> Column:
    """The place in writing order of a row of a turn; a turn has up to a million rows of a step."""
    return (F.col("turn_index").cast("long") * 4 + step) * 1_000_000 + (pos if isinstance(pos, int) else pos.cast("long"))


def verbatim_turns(turns: DataFrame) -> DataFrame:
    """Every turn as two memories: with its time and speaker in the text, and the plain text."""
    time = F.col("timestamp")
    head = F.when(time.isNotNull(), F.concat(F.lit("[verbatim_turn time="), time, F.lit("] "))).otherwise("")
    pairs = {"memory_kind": F.lit("verbatim_turn"), "speaker": F.col("speaker"), "turn_id": F.col("id")}
    out = None
    for step, content, (importance, confidence), more in ((0, F.concat(head, "speaker", F.lit(": "), "text"), PREFIXED, {}), (1, F.col("text"), PLAIN, {"verbatim_form": F.lit("turn_text")})):
        part = turns.select(
            stable_id("turn", F.col("conversation_id"), F.col("id"), F.lit(step)).alias("id"), F.col("conversation_id").alias("namespace"), F.lit("episodic").alias("memory_type"), content.alias("content"),
            F.col("id").alias("source_event_id"), F.lit(importance).alias("importance"), F.lit(confidence).alias("confidence"), _meta({**pairs, **more}, time).alias("metadata"), _place(step).alias("seq"),
        )
        out = part if out is None else out.unionByName(part)
    return enrich(out)


def session_key() -> Column:
    return F.when(F.col("timestamp").isNotNull(), F.concat(F.lit("time:"), "timestamp")).otherwise("conversation")


def verbatim_sessions(turns: DataFrame) -> DataFrame:
    """Sessions of two turns or more (turns of one time) as transcripts; a conversation without any, but of two turns, is one."""
    keyed = turns.withColumn("key", session_key())
    line = F.struct("turn_index", F.concat("speaker", F.lit(": "), "text", F.lit("\n")).alias("line"), "id", "timestamp")
    by_key = keyed.groupBy("conversation_id", "key").agg(F.array_sort(F.collect_list(line)).alias("t"))
    per = by_key.groupBy("conversation_id").agg(F.max(F.size("t")).alias("most"), F.sum(F.size("t")).alias("all"))
    alone = keyed.join(per.filter("most < 2 and all > 1").select("conversation_id"), "conversation_id", "left_semi")
    whole = alone.groupBy("conversation_id").agg(F.array_sort(F.collect_list(line)).alias("t")).withColumn("key", F.lit("conversation"))
    sessions = by_key.filter(F.size("t") >= 2).unionByName(whole)
    time = F.get(F.filter(F.transform("t", lambda x: x["timestamp"]), lambda x: x.isNotNull()), F.lit(0))
    head = F.when(time.isNotNull(), F.concat(F.lit("[verbatim_session time="), time, F.lit("]\n"))).otherwise("[verbatim_session]\n")
    place = F.lit(1 << 55) + F.row_number().over(Window.partitionBy("conversation_id").orderBy("key"))
    rows = sessions.select(
        stable_id("sess", F.col("conversation_id"), F.col("key")).alias("id"), F.col("conversation_id").alias("namespace"), F.lit("episodic").alias("memory_type"),
        F.concat(head, F.array_join(F.transform("t", lambda x: x["line"]), "")).alias("content"), F.col("t")[0]["id"].alias("source_event_id"), F.lit(SESSION[0]).alias("importance"), F.lit(SESSION[1]).alias("confidence"),
        _meta({"memory_kind": F.lit("verbatim_session"), "session_key": F.col("key"), "source_turn_ids": F.array_join(F.transform("t", lambda x: x["id"]), "\n")}, time).alias("metadata"), place.alias("seq"),
    )
    return enrich(rows)


def dataset_memories(turns: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """All memories of a dataset's turns before they are merged: verbatim turns, extracted memories, observations, sessions.

    ``found`` are candidates of an extractor (see ``extract.llm_candidates``); by default those of the rules.
    """
    events = turns.selectExpr("conversation_id namespace", "id event_id", "speaker actor", "text", "timestamp", "turn_index")
    places = turns.selectExpr("conversation_id namespace", "id event_id", "turn_index")
    found = candidates(events, ("turn_index",)) if found is None else found.join(places, ["namespace", "event_id"])
    meta = F.col("metadata") if "metadata" in found.columns else F.create_map().cast("map<string,string>")
    extracted = found.select(
        stable_id("mem", F.col("event_id"), F.col("pos"), F.col("content")).alias("id"), "namespace", "memory_type", "content", F.col("event_id").alias("source_event_id"),
        F.col("importance").cast("double").alias("importance"), F.col("confidence").cast("double").alias("confidence"), meta.alias("metadata"), _place(2, F.col("pos")).alias("seq"),
    )
    seen = observe.observations(events)
    noted = observe.as_memories(seen).withColumnRenamed("source_event_id", "event_id").join(places, ["namespace", "event_id"]).withColumnRenamed("event_id", "source_event_id").withColumn("seq", _place(3)).drop("turn_index")
    return verbatim_turns(turns).unionByName(extracted).unionByName(noted).unionByName(verbatim_sessions(turns))


def ingest_dataset(turns: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The merged memories of a dataset's turns."""
    return fold(dataset_memories(turns, found))
