"""Streams with state by key and event-time sessions: the batch operators' results, whatever the micro-batches."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_sources import TURN, micro_batches

from recallforge.operators import ingest
from recallforge.streaming import keyed

SCHEMA = "id string, namespace string, memory_type string, content string, source_event_id string, importance double, confidence double, metadata map<string,string>, seq long"


class Held:
    """A state of one key that counts what is read."""

    def __init__(self, reads):
        self.reads, self.value, self.values, self.list = reads, None, {}, None

    def exists(self):
        return self.value is not None or self.list is not None

    def get(self):
        self.reads.append(1)
        return self.value if self.list is None else iter(self.list)

    def update(self, value):
        self.value = value

    def put(self, rows):
        self.list = rows

    def clear(self):
        self.value = self.list = None

    def containsKey(self, key):
        return key in self.values

    def getValue(self, key):
        self.reads.append(1)
        return self.values[key]

    def updateValue(self, key, value):
        self.values[key] = value


class Handle:
    def __init__(self):
        self.reads, self.timers = [], set()

    def getValueState(self, *_):
        return Held(self.reads)

    getMapState = getListState = getValueState

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def memory_rows(n, rnd):
    words = [f"word{i}" for i in range(30)] + ["a", "so"]
    contents = []
    for _ in range(n):
        contents.append(rnd.choice([rnd.choice(contents or ["a so"]), " ".join(rnd.sample(words, rnd.randint(1, 8))), rnd.choice(contents or ["x"]).upper(), rnd.choice(contents or ["y"]) + " so"]))
    return [(f"m{i}", rnd.choice("np"), "semantic", c, f"e{i}", i % 7 / 10, i % 5 / 10, {"k": str(i)} if i % 11 else {"side_channel": "x"}, i) for i, c in enumerate(contents)]


def test_streamed_merges_equal_batch(spark, tmp_path):
    rows = memory_rows(90, random.Random(3))

    def make(stream):
        return keyed.fold(stream)

    make.mode = "update"
    versions = micro_batches(spark, make, [rows[:40], rows[40:41], rows[41:]], SCHEMA, tmp_path)
    fields = F.struct("content", "importance", "confidence", "seq", "merged", F.array_sort(F.map_entries("metadata")).alias("m"))
    last = versions.groupBy("id").agg(F.max_by(fields, F.struct("_b", "merged")).alias("x")).select("id", "x.*")
    batch = ingest.fold(spark.createDataFrame(rows, SCHEMA)).select("id", "content", "importance", "confidence", "seq", "merged", F.array_sort(F.map_entries("metadata")).alias("m"))
    assert sorted(map(str, last.collect())) == sorted(map(str, batch.collect())) and 10 < batch.count() < 80


def test_a_batch_reads_what_its_rows_need():
    folding, handle = keyed.Folding(0.72), Handle()
    folding.init(handle)
    columns = ["id", "content", "source_event_id", "importance", "confidence", "metadata", "seq", "side_channel"]

    def give(contents, seq):
        rows = pd.DataFrame([(f"m{seq + i}", c, None, 0.5, 0.5, None, seq + i, False) for i, c in enumerate(contents)], columns=columns)
        return pd.concat(list(folding.handleInputRows(("n", "semantic"), iter([rows]), None)))

    reads = []
    for k in range(6):
        handle.reads.clear()
        out = give([f"thing{k}x{i} other{k}y{i} at the place" for i in range(300)], 300 * k)
        assert len(out) == 300 and set(out["merged"]) == {1}
        reads.append(len(handle.reads))
    assert max(reads) <= 1  # of other memories: none, however many memories there are
    handle.reads.clear()
    assert give(["thing3x7 other3y7 at the place"], 9000).to_dict("records")[0]["merged"] == 2 and len(handle.reads) < 12


@pytest.mark.parametrize("cut", [3, 8])
def test_streamed_windows_equal_batch(spark, tmp_path, cut):
    rows = [(f"c{i % 2}", i, "u", f"t{i}") for i in range(13)]
    ends = [("c0", 99, "u", None), ("c1", 99, "u", None)]

    def make(stream):
        return keyed.windows(stream, 4)

    make.mode = "append"
    got = {(r.namespace, r.window, r.full, r.n_turns, r.combined) for r in micro_batches(spark, make, [rows[:cut], rows[cut:], ends], TURN, tmp_path).drop("_b").collect()}
    assert got == {tuple(r) for r in ingest.windows(spark.createDataFrame(rows, TURN), 4).collect()}


def test_an_idle_conversation_is_flushed_once():
    windowing, handle = keyed.Windowing(3, 1000), Handle()
    windowing.init(handle)
    rows = pd.DataFrame([(1, "u", "a"), (2, "u", "b")], columns=["seq", "actor", "text"])
    assert pd.concat(list(windowing.handleInputRows(("c",), iter([rows]), Clock(50)))).empty and handle.timers == {1050}
    more = pd.concat(list(windowing.handleInputRows(("c",), iter([rows.assign(text="x")]), Clock(90))))
    assert list(more["full"]) == [True] and handle.timers == {1090}
    left = pd.concat(list(windowing.handleExpiredTimer(("c",), Clock(1090), None)))
    assert list(left["full"]) == [False] and list(left["n_turns"]) == [2] and not windowing.turns.exists() and not windowing.made.exists()
    with pytest.raises(ValueError):
        keyed.windows(None, 0)


def plain_sessions(rows, gap):
    out = []
    for ns, t, seq, actor, text in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0], r[1], r[2])):
        if out and out[-1][0] == ns and t - out[-1][2][-1][0] <= gap:
            out[-1][2].append((t, seq, f"{actor}: {text}"))
        else:
            out.append((ns, t, [(t, seq, f"{actor}: {text}")]))
    return {(ns, start, lines[-1][0] + gap, len(lines), "\n".join(x for _, _, x in lines)) for ns, start, lines in out}


def test_sessions_by_event_time_equal_batch_in_any_order(spark, tmp_path):
    rnd, day = random.Random(5), dt.datetime(2024, 1, 1)
    schema = "namespace string, time timestamp, seq long, actor string, text string"
    rows = [(rnd.choice("ab"), day + dt.timedelta(minutes=5 * rnd.randrange(400)), i, "u", f"t{i}") for i in range(120)]
    rows.sort(key=lambda r: r[1])
    gap = dt.timedelta(minutes=30)
    want = plain_sessions(rows, gap)
    assert {tuple(r) for r in keyed.gap_sessions(spark.createDataFrame([*rows, ("a", None, 999, "u", "x")], schema), "30 minutes").collect()} == want and len(want) > 10
    # neighbours swapped within an hour of event time, and a turn that comes too late in the end
    given = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rnd.randrange(55)))
    late = [("a", day, 5000, "u", "too late")]
    end = [(ns, day + dt.timedelta(days=9), 7000, "u", "end") for ns in "ab"]

    def make(stream):
        return keyed.gap_sessions(stream, "30 minutes", "1 hour")

    make.mode = "append"
    got = micro_batches(spark, make, [given[:50], given[50:100], given[100:], end, late], schema, tmp_path).drop("_b").collect()
    assert {tuple(r) for r in got} == want
