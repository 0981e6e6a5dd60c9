"""Helpers that the training-data operators share: shared-folder tables, Arrow text blocks, word digests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on exactly these.
SPACE = r"[\x20\x09-\x0D]+"
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (local tests), a temporary one that is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='recallforge-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and a lost executor loses none of it.

    With columns ``by`` it is laid out by them, so that a filter on them reads its part only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run of an operator in the shared folder, dropped once nothing reads them any more."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """As ``materialize``; the table is gone after ``drop``."""
        path = f"{shared_dir(self.spark)}/{self.tag}-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def lasting(self, df: DataFrame, name: str) -> DataFrame:
        """As ``table``, for what the operator's result still reads: ``drop`` leaves it."""
        return materialize(df, f"{self.tag}-{name}")

    def drop(self) -> None:
        """Delete the tables written so far; call it when all that was computed from them is written elsewhere."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        self.paths.clear()


#: Bits of a bitmap that is broadcast (16 MB), and how many bitmaps a sieve has at most.
MOST_BITS, MOST_PASSES = 1 << 27, 16


def sifted(rows: DataFrame, among: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: whether their ``key`` may be in the column ``key`` of ``among``.

    The keys become a bitmap of 16 bits a key, aggregated on the executors, that is broadcast; ``MOST_BITS`` is its bound.
    More keys have fewer bits each, down to four; beyond that they are cut into ranges of a digest, each with a bitmap and
    a scan of the rows of its range.  A row whose key is there is always marked; of the others few are (one in 16 with 16
    bits, one in five with four), and slowly more once ``MOST_PASSES`` bitmaps are full, at half a billion keys.
    """
    n = among.count()
    passes = min(MOST_PASSES, max(1, -(-4 * n // MOST_BITS)))
    bits = min(MOST_BITS, 1 << max(15, (16 * n // passes).bit_length()))
    place, turn = (F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(m)) for salt, m in (("sieve", bits), ("pass", passes)))
    out = None
    for k in range(passes):
        mine, theirs = (rows, among) if passes == 1 else (rows.filter(turn == k), among.filter(turn == k))
        maps = theirs.select(place.alias("at")).groupBy(F.expr("at >> 15").alias("m_bucket")).agg(F.bitmap_construct_agg(F.expr("at & 32767L")).alias("m_bits"))
        placed = mine.withColumn("m_at", place).join(F.broadcast(maps), F.expr("m_at >> 15 = m_bucket"), "left")
        # the bytes of a bitmap hold their lowest bit first
        bit = F.expr("cast(conv(hex(substring(m_bits, cast((m_at & 32767L) / 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(m_at % 8 as int)) <> 0")
        part = placed.select(*rows.columns, F.coalesce(bit, F.lit(False)).alias(name))
        out = part if out is None else out.unionByName(part)
    return out


def sieve(rows: DataFrame, among: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """The rows that ``sifted`` marks, before a join with ``among`` that shuffles them; the join's result is the same.

    With ``most``, all rows pass where 16 bits a key are more than that.
    """
    if most is not None and 16 * among.count() > most:
        return rows
    return sifted(rows, among, key, "m_in").filter("m_in").drop("m_in")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of ``documents``; nothing else is read."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text (one row at least)."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    block = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *edges], [*edges, len(sizes)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer on uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit digest of each word; the same on every machine."""
    held = np.empty(len(words), dtype=object)
    held[:] = words
    return pd.util.hash_array(held, categorize=False) if words else np.empty(0, np.uint64)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Digests of the runs of ``n`` consecutive values of ``h``."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(m, np.uint64)
    for j in range(n):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
    return mix(acc)


def sequence_hash(h: np.ndarray) -> int:
    """One 64-bit digest of a whole sequence, as a signed integer."""
    if not len(h):
        return 0
    steps = mix(np.arange(1, len(h) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(h ^ steps), dtype=np.uint64) + np.uint64(len(h))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
