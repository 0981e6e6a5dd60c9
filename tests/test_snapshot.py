"""The store of snapshots and deltas: replay, one-bucket reads, clashing writers, compaction."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recallforge.schema import DuplicateEvent, MemoryQuery, StoreError, events, memories
from recallforge.sources.snapshot import SnapshotStore


def at(day):
    return F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp")


def rows(spark, pairs, day=1):
    return memories(spark.createDataFrame(pairs, "id string, content string"), at(day))


def state(store, version=None):
    return {r.id: (r.content, r.created_at.day, r.deleted_at.day if r.deleted_at else None) for r in store.memories(version).collect()}


def filled(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", at(3), buckets=8)
    store.add_memories(rows(spark, [(f"m{i}", f"text {i}") for i in range(20)]))
    store.update_memories(rows(spark, [("m3", "new 3"), ("m4", "new 4"), ("m4", "newer 4")], 2).coalesce(1))
    store.delete_memories(spark.createDataFrame([("m4",), ("m5",), ("unknown",)], "id string"))
    store.update_memories(rows(spark, [("m5", "back 5")], 4))
    return store


def test_replay_versions_and_compaction(spark, tmp_path):
    store = filled(spark, tmp_path)
    want = {f"m{i}": (f"text {i}", 1, None) for i in range(20)} | {"m3": ("new 3", 1, None), "m4": ("newer 4", 1, 3), "m5": ("back 5", 1, None)}
    assert state(store) == want and store.versions() == [1, 2, 3, 4]
    assert state(store, 1)["m4"] == ("text 4", 1, None) and state(store, 3)["m5"] == ("text 5", 1, 3)
    with pytest.raises(StoreError):
        store.memories(9)
    assert store.compact() == 5 and state(store) == want and len(store.manifest()["files"]) == 1
    store.update_memories(rows(spark, [("m3", "after")], 6))
    assert state(store)["m3"] == ("after", 1, None) and state(store)["m4"] == want["m4"]
    assert len(store.vacuum()) == 4 and store.versions() == [6] and state(store)["m3"][0] == "after" and len(state(store)) == 20
    assert [r.id for r in store.list_memories(MemoryQuery(limit=2, include_expired=True)).collect()][0] == "m3"
    with pytest.raises(StoreError):
        store.delete_in("default", spark.createDataFrame([("m4",)], "id string"))  # it is deleted
    empty = SnapshotStore(spark, f"file://{tmp_path}/none")
    assert empty.memories().count() == 0 and empty.get_memory("x").count() == 0 and empty.compact() == 1 and empty.events().count() == 0


def test_one_id_reads_one_bucket(spark, tmp_path):
    store = filled(spark, tmp_path)
    store.compact()
    found = store.get_memory("m7")
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "bucket#" in plan.split("PartitionFilters")[1].split("\n")[0] and "EqualTo(id,m7)" in plan
    assert [r.content for r in found.collect()] == ["text 7"] and store.get_memory("m4").count() == 0
    # files of other buckets are not opened
    own = {p for p in (tmp_path / "s" / "data").glob("*/bucket=*/*.parquet") if "m7" in pq.read_table(p, partitioning=None).column("id").to_pylist()}
    for p in (tmp_path / "s" / "data").glob("*/bucket=*/*.parquet"):
        if p.parent.name not in {q.parent.name for q in own}:
            p.write_bytes(b"no parquet")
            p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
    assert [r.content for r in store.get_memory("m7").collect()] == ["text 7"]


def test_writers_that_clash_are_tried_anew(spark, tmp_path, monkeypatch):
    store = filled(spark, tmp_path)
    other = SnapshotStore(spark, store.path, at(5))
    put, clashes = SnapshotStore._put, []

    def slow(self, manifest):
        if self is store and not clashes:  # another writer commits between this one's reading and its commit
            clashes.append(manifest["version"])
            other.update_memories(rows(spark, [("m9", "theirs"), ("m8", "theirs")], 5))
        return put(self, manifest)

    monkeypatch.setattr(SnapshotStore, "_put", slow)
    store.update_memories(rows(spark, [("m8", "mine")], 5))
    assert clashes == [5] and store.versions() == [1, 2, 3, 4, 5, 6]
    assert state(store)["m9"][0] == "theirs" and state(store)["m8"][0] == "mine"
    assert put(store, {**store.manifest(), "version": 6}) is False  # a version is taken once
    clashes.clear()
    store.compact()  # what came meanwhile stays beside the snapshot
    assert clashes == [7] and len(store.manifest()["files"]) == 2 and state(store)["m8"][0] == "theirs"


def test_an_event_id_is_added_once(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, f"file://{tmp_path}/e")
    one = events(spark.createDataFrame([("e1", "a"), ("e2", "b")], "id string, text string"))
    store.add_events(one)
    with pytest.raises(DuplicateEvent):
        store.add_events(one.limit(1))
    with pytest.raises(DuplicateEvent):
        store.add_events(events(spark.createDataFrame([("e7", "a"), ("e7", "b")], "id string, text string")))
    put = SnapshotStore._put
    other, done = SnapshotStore(spark, store.path), []

    def slow(self, manifest):
        if self is store and not done:
            done.append(1)
            other.add_events(events(spark.createDataFrame([("e3", "theirs")], "id string, text string")))
        return put(self, manifest)

    monkeypatch.setattr(SnapshotStore, "_put", slow)
    with pytest.raises(DuplicateEvent):
        store.add_events(events(spark.createDataFrame([("e3", "mine")], "id string, text string")))
    assert sorted((r.id, r.text) for r in store.events().collect()) == [("e1", "a"), ("e2", "b"), ("e3", "theirs")]
    assert [r.id for r in store.list_events("default").collect()] == ["e1", "e2", "e3"]
