"""A store of bucketed snapshots and deltas: a manifest a version, committed by put-if-absent.

Rows are laid out by a digest of their id, so a read of one id opens one bucket.  A write adds files and then the next
manifest, which lists the files of the store; if another writer has put that manifest first, the writer reads the new one
and tries the one after it.  A row's version is that of the manifest that brought its files, so nothing is scanned for it
and no file is written again.  ``compact`` replaces what a manifest lists by one snapshot; files that no kept manifest
lists go with ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recallforge.schema import EVENT, MEMORY, DuplicateEvent, MemoryQuery, StoreError
from recallforge.sources import log
from recallforge.sources.store import MemoryStore

#: Files are in so many buckets by default, and a commit is tried so often.
BUCKETS, TRIES = 64, 20
_SCHEMAS = {"event": f"{EVENT}, op string, held long, born timestamp, write string, bucket int", "memory": f"{MEMORY}, op string, held long, born timestamp, write string, bucket int"}


def bucket_of(id_: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")


class SnapshotStore(MemoryStore):
    """Memories and events at a path that several writers may share.

    A manifest is {"version", "buckets", "files": [{"name", "kind", "version"}]}; ``name`` is a folder of Parquet files by
    bucket, of a write or of a snapshot.  Put-if-absent is the file system's creation of a file that must not exist, which
    HDFS and object stores with conditional puts do atomically.
    """

    def __init__(self, spark: SparkSession, path: str, now: Column | None = None, buckets: int = BUCKETS):
        super().__init__(spark, now)
        self.path, self.buckets = path.rstrip("/"), buckets

    # ---- manifests

    def _fs(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _names(self, folder: str) -> list[str]:
        fs, place = self._fs(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the latest one."""
        known = self.versions()
        if not known and version is None:
            return {"version": 0, "buckets": self.buckets, "files": []}
        if version is not None and version not in known:
            raise StoreError(f"no version {version} at {self.path}")
        fs, place = self._fs(f"{self.path}/manifests/{known[-1] if version is None else version:012d}.json")
        stream = fs.open(place)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> bool:
        """Whether this manifest is now the one of its version."""
        from py4j.protocol import Py4JJavaError

        fs, place = self._fs(f"{self.path}/manifests/{manifest['version']:012d}.json")
        try:
            stream = fs.create(place, False)
        except Py4JJavaError as e:
            if fs.exists(place):
                return False
            raise StoreError(str(e.java_exception)) from e
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        return True

    def _commit(self, change: Callable[[dict], list[dict]]) -> int:
        """Puts the manifest after the latest one, with the files that ``change`` makes of it; tries anew if another writer was first."""
        for _ in range(TRIES):
            now = self.manifest()
            version = now["version"] + 1
            files = [{**f, "version": f.get("version") or version} for f in change(now)]
            if self._put({"version": version, "buckets": now["buckets"], "files": files}):
                return version
        raise StoreError(f"{TRIES} other writers were first at {self.path}")

    # ---- reading

    def _read(self, kind: str, manifest: dict) -> DataFrame:
        """All rows of a kind with ``op`` (put or delete), ``version``, and ``born``, the time of an id's first version in a snapshot."""
        files = [f for f in manifest["files"] if f["kind"] == kind]
        if not files:
            return self.spark.createDataFrame([], _SCHEMAS[kind]).withColumnRenamed("held", "version").drop("write")
        rows = self.spark.read.schema(_SCHEMAS[kind]).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/write={f['name']}" for f in files])
        # rows of a write have the version of their manifest, those of a snapshot their own
        of = F.create_map(*[F.lit(x) for f in files for x in (f["name"], f["version"])])
        return rows.withColumn("version", F.coalesce("held", of[F.col("write")].cast("long"))).drop("held", "write")

    def _state(self, kind: str, rows: DataFrame) -> DataFrame:
        """The last version of every id, of memories with the time of a later delete; and the time it first had."""
        put = F.col("op") == "put"
        fields = [c for c in rows.columns if c not in ("op", "version", "born", "bucket")]
        held = rows.groupBy("id").agg(
            F.max_by(F.when(put, F.struct(*fields, "version")), F.when(put, F.col("version"))).alias("m"),
            F.min_by(F.when(put, F.coalesce("born", "created_at")), F.when(put, F.col("version"))).alias("first"),
            F.max_by(F.when(~put, F.struct("created_at", "version")), F.when(~put, F.col("version"))).alias("d"),
        ).filter("m is not null")
        out = {c: F.col(f"m.{c}") for c in fields} | {"created_at": F.col("first")}
        if kind == "memory":
            out["deleted_at"] = F.when(F.col("d.version") > F.col("m.version"), F.col("d.created_at")).otherwise(F.col("m.deleted_at"))
        return held.select(*[v.alias(c) for c, v in out.items()], F.col("m.version").alias("version"))

    def events(self, version: int | None = None) -> DataFrame:
        return self._state("event", self._read("event", self.manifest(version))).drop("version")

    def memories(self, version: int | None = None) -> DataFrame:
        """All memories, deleted ones too, by default of the latest version."""
        return self._state("memory", self._read("memory", self.manifest(version))).drop("version")

    def get_memory(self, id_: str) -> DataFrame:
        """The memory of an id, unless it is deleted; from the files of its bucket."""
        manifest = self.manifest()
        bucket = self.spark.range(1).select(bucket_of(F.lit(id_), manifest["buckets"]).alias("b")).first().b
        rows = self._read("memory", manifest).filter((F.col("bucket") == bucket) & (F.col("id") == id_))
        return self._state("memory", rows).drop("version").filter("deleted_at is null")

    def _listed(self, seen: DataFrame, query: MemoryQuery) -> DataFrame:
        recent = self.seen(seen, query, True).orderBy(F.desc("updated_at"), "id").limit(query.limit)
        return log.visible(recent, side_channel=query.include_side_channel)

    # ---- writing

    def _files(self, kind: str, rows: DataFrame, buckets: int, as_of: bool = False) -> str:
        """Writes rows by bucket; the name of their folder."""
        name = uuid.uuid4().hex
        fields = [f for f in StructType.fromDDL(_SCHEMAS[kind]) if f.name != "write"]
        have = rows if as_of else rows.withColumns({"held": F.lit(None).cast("long"), "born": F.lit(None).cast("timestamp")})
        out = have.withColumn("bucket", bucket_of(F.col("id"), buckets)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        out.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/write={name}")
        return name

    def _append(self, kind: str, rows: DataFrame) -> None:
        table = "event" if kind == "event" else "memory"
        fields = [f.split(" ")[0] for f in (EVENT if table == "event" else MEMORY).split(", ")]
        if kind == "delete":
            gone = rows.groupBy("id").agg(F.max("created_at").alias("created_at"))
            once = gone.select(*[F.col(c) if c in ("id", "created_at") else F.lit(None).alias(c) for c in fields])
        else:  # of an id that comes twice in one write the last row counts
            once = log.latest(rows.select(*fields).withColumn("_at", F.monotonically_increasing_id()), "id", "_at").select(*fields)
        start = self.manifest()
        name = self._files(table, once.withColumn("op", F.lit("delete" if kind == "delete" else "put")), start["buckets"])
        self._commit(lambda now: [*now["files"], {"name": name, "kind": table}])

    def add_events(self, events: DataFrame) -> None:
        """Events of new ids; an id that is there already, or is put there by another writer meanwhile, is an error."""
        ids = events.select("id")
        twice = ids.groupBy("id").count().filter("count > 1").select("id").limit(1).collect()
        if twice:
            raise DuplicateEvent(f"event {twice[0].id} comes twice")
        fields = [f.split(" ")[0] for f in EVENT.split(", ")]
        start, seen = self.manifest(), set()
        name = self._files("event", events.select(*fields).withColumn("op", F.lit("put")), start["buckets"])
        mine = self.spark.read.schema(_SCHEMAS["event"]).parquet(f"{self.path}/data/write={name}").select("id")

        def change(now: dict) -> list[dict]:
            new = [f for f in now["files"] if f["kind"] == "event" and f["name"] not in seen]
            known = self._read("event", {"files": new}).select("id")
            held = mine.join(known, "id", "left_semi").limit(1).collect() if new else []
            if held:
                raise DuplicateEvent(f"event {held[0].id} is there already")
            seen.update(f["name"] for f in new)
            return [*now["files"], {"name": name, "kind": "event"}]

        self._commit(change)

    def add_memories(self, memories: DataFrame) -> None:
        """New memories are never deleted ones."""
        self._append("memory", memories.withColumn("deleted_at", F.lit(None).cast("timestamp")))

    # ---- upkeep

    def compact(self) -> int:
        """One snapshot instead of all files of the latest manifest; what others write meanwhile stays beside it."""
        start, made = self.manifest(), []
        for kind in ("event", "memory"):
            if any(f["kind"] == kind for f in start["files"]):
                state = self._state(kind, self._read(kind, start)).withColumns({"op": F.lit("put"), "born": F.col("created_at")}).withColumnRenamed("version", "held")
                made.append({"name": self._files(kind, state, start["buckets"], as_of=True), "kind": kind})
        old = {f["name"] for f in start["files"]}
        return self._commit(lambda now: made + [f for f in now["files"] if f["name"] not in old])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes manifests but the last ``keep``, and files that none of these lists; no writer may be at work."""
        versions = self.versions()
        kept = {f["name"] for v in versions[-keep:] for f in self.manifest(v)["files"]}
        gone = [n for n in self._names("data") if n.removeprefix("write=") not in kept]
        for path in [f"{self.path}/manifests/{v:012d}.json" for v in versions[:-keep]] + [f"{self.path}/data/{n}" for n in gone]:
            fs, place = self._fs(path)
            fs.delete(place, True)
        return gone
