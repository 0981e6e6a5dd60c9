"""Stores of events and memories over the record log: three listings, one set of batch writes.

Writes append versions; nothing is changed in place, so a lost executor or a second writer of other ids harms nothing.
Reads replay the log, where the last version wins.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.schema import EVENT, MEMORY, DuplicateEvent, MemoryQuery, StoreError
from recallforge.sources import log


class MemoryStore:
    """What every store offers; ``now`` is the time of writes and of validity, by default the clock."""

    def __init__(self, spark: SparkSession, now: Column | None = None):
        self.spark = spark
        self.now = F.current_timestamp() if now is None else now

    # what a store has to define
    def events(self) -> DataFrame:
        raise NotImplementedError

    def memories(self) -> DataFrame:
        """All memories, deleted ones too."""
        raise NotImplementedError

    def _append(self, kind: str, rows: DataFrame) -> None:
        raise NotImplementedError

    def _listed(self, seen: DataFrame, query: MemoryQuery) -> DataFrame:
        raise NotImplementedError

    # what all have in common
    def add_events(self, events: DataFrame) -> None:
        self._append("event", events)

    def add_memories(self, memories: DataFrame) -> None:
        self._append("memory", memories)

    def update_memories(self, memories: DataFrame) -> None:
        """New versions, stamped with the time of the update."""
        self._append("memory", memories.withColumn("updated_at", self.now))

    def delete_memories(self, ids: DataFrame) -> None:
        """Soft deletes of the column ``id``; unknown ids do nothing."""
        self._append("delete", ids.select("id", self.now.alias("created_at")))

    def delete_in(self, namespace: str, ids: DataFrame) -> None:
        """Soft deletes within a namespace; raises if an id is not a memory of it."""
        own = self.memories().filter((F.col("namespace") == namespace) & F.col("deleted_at").isNull()).select("id")
        other = ids.select("id").join(own, "id", "left_anti").limit(1).collect()
        if other:
            raise StoreError(f"no memory {other[0].id} in {namespace}")
        self.delete_memories(ids)

    def get_memory(self, id_: str) -> DataFrame:
        """The memory of an id, unless it is deleted."""
        return self.memories().filter((F.col("id") == id_) & F.col("deleted_at").isNull())

    def list_events(self, namespace: str) -> DataFrame:
        return self.events().filter(F.col("namespace") == namespace).orderBy("id")

    def list_memories(self, query: MemoryQuery) -> DataFrame:
        return self._listed(self.memories(), query)

    def seen(self, rows: DataFrame, query: MemoryQuery, side_channel: bool) -> DataFrame:
        return log.visible(rows, query.namespace, query.memory_types or None, None if query.include_expired else self.now, side_channel)


class FileStore(MemoryStore):
    """A folder of text batches in the log's line format; a listing is in the order of ids, whatever the limit."""

    def __init__(self, spark: SparkSession, path: str, now: Column | None = None):
        super().__init__(spark, now)
        self.path = path.rstrip("/")

    def _batches(self) -> list[int]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = place.getFileSystem(conf)
        names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def _parsed(self) -> DataFrame:
        if not self._batches():
            lines = self.spark.createDataFrame([], "seq struct<batch:long,file:string,start:long,row:long>, line string")
        else:
            lines = log.read_lines(self.spark, self.path)
        return log.checked(log.parse(lines))

    def events(self) -> DataFrame:
        return log.replay_events(self._parsed())

    def memories(self) -> DataFrame:
        return log.replay_memories(self._parsed())

    def _append(self, kind: str, rows: DataFrame) -> None:
        lines = {"event": log.encode_event, "memory": log.encode_memory, "delete": lambda: log.encode_delete(F.col("id"), F.col("created_at"))}[kind]()
        batch = max([0, *self._batches()]) + 1
        rows.select(lines.alias("value")).write.mode("errorifexists").text(f"{self.path}/batch={batch:09d}")

    def _listed(self, seen: DataFrame, query: MemoryQuery) -> DataFrame:
        return self.seen(seen, query, query.include_side_channel).orderBy("id")


class VersionedStore(MemoryStore):
    """Rows with the number of the write that they came by; the last version of an id wins."""

    def _read(self, kind: str) -> DataFrame:
        """All versions of events or memories, with ``version``."""
        raise NotImplementedError

    def _write(self, kind: str, rows: DataFrame) -> None:
        raise NotImplementedError

    def _latest(self, kind: str) -> DataFrame:
        rows = self._read(kind)
        last = rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), "version").alias("m"), F.min_by("created_at", "version").alias("born"))
        return last.select(*[F.col("born" if c == "created_at" else f"m.{c}").alias(c) for c in rows.columns if c != "version"])

    def events(self) -> DataFrame:
        return self._latest("event")

    def memories(self) -> DataFrame:
        return self._latest("memory")

    def _append(self, kind: str, rows: DataFrame) -> None:
        if kind == "delete":
            gone = rows.groupBy("id").agg(F.max("created_at").alias("gone_at"))
            rows = self.memories().join(gone, "id").withColumn("deleted_at", F.col("gone_at")).drop("gone_at")
        table = "event" if kind == "event" else "memory"
        have = self._read(table)
        version = (have.agg(F.max("version")).first()[0] or 0) + 1
        # of an id that comes twice in one write the last row counts
        once = log.latest(rows.select(*have.drop("version").columns).withColumn("_at", F.monotonically_increasing_id()), "id", "_at")
        self._write(table, once.select(*have.drop("version").columns).withColumn("version", F.lit(version).cast("long")))


class VolatileStore(VersionedStore):
    """Versions persisted in the session; a listing is the first ``limit`` by id; updates keep their own time."""

    def __init__(self, spark: SparkSession, now: Column | None = None):
        super().__init__(spark, now)
        self._writes = {k: [spark.createDataFrame([], f"{schema}, version long")] for k, schema in (("event", EVENT), ("memory", MEMORY))}

    def _read(self, kind: str) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, self._writes[kind])

    def _write(self, kind: str, rows: DataFrame) -> None:
        kept = rows.coalesce(self.spark.sparkContext.defaultParallelism).persist()
        kept.count()  # before the store changes
        self._writes[kind].append(kept)

    def update_memories(self, memories: DataFrame) -> None:
        self._append("memory", memories)

    def _listed(self, seen: DataFrame, query: MemoryQuery) -> DataFrame:
        return self.seen(seen, query, query.include_side_channel).orderBy("id").limit(query.limit)


class TableStore(VersionedStore):
    """Parquet tables of versions, laid out by namespace: an event id may be added once, and a listing takes the ``limit`` most recently
    updated memories before it drops side channels, so it may be shorter."""

    def __init__(self, spark: SparkSession, path: str, now: Column | None = None):
        super().__init__(spark, now)
        self.path = path.rstrip("/")

    def _read(self, kind: str) -> DataFrame:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        whole = f"{EVENT if kind == 'event' else MEMORY}, version long"
        if not place.getFileSystem(conf).exists(place):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.path}/{kind}")

    def _write(self, kind: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("namespace").parquet(f"{self.path}/{kind}")

    def add_events(self, events: DataFrame) -> None:
        ids = events.select("id")
        twice = ids.groupBy("id").count().filter("count > 1").select("id").unionByName(ids.join(self._read("event").select("id"), "id", "left_semi")).limit(1).collect()
        if twice:
            raise DuplicateEvent(f"event {twice[0].id} is there already")
        self._append("event", events)

    def add_memories(self, memories: DataFrame) -> None:
        """New memories are never deleted ones."""
        self._append("memory", memories.withColumn("deleted_at", F.lit(None).cast("timestamp")))

    def list_events(self, namespace: str) -> DataFrame:
        return self.events().filter(F.col("namespace") == namespace)

    def _listed(self, seen: DataFrame, query: MemoryQuery) -> DataFrame:
        recent = self.seen(seen, query, True).orderBy(F.desc("updated_at"), "id").limit(query.limit)
        return log.visible(recent, side_channel=query.include_side_channel)
