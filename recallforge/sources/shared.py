"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset on a local master (tests), a temporary one that is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='recallforge-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table, wherever its file system is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small file, wherever its file system is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.setWriteChecksum(False)  # no hidden files beside it on a local disk
    try:
        stream = fs.create(place, True)
        stream.write(bytearray(text.encode()))
        stream.close()
    finally:
        fs.setWriteChecksum(True)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """One file that fits the driver's memory, wherever its file system is."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut, and a lost executor loses none of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run, which are deleted at its end, also where it fails: ``with Scratch(spark) as scratch``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths.clear()

    def path(self, name: str) -> str:
        self.paths.append(f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
