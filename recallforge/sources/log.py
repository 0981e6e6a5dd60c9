"""The versioned record log: lines of tab-separated fields, and its replay, where the last record of an id wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.functions.text import hex_pairs
from recallforge.schema import CorruptStore, memory_type

# Escapes of a field, kinds of records with their number of fields, and a memory's fields.
ESCAPES = (("\t", "t"), ("\n", "n"), ("\r", "r"), ("=", "e"), (";", "s"))
ARITY = {"event": 7, "memory": 15, "delete": 3}
MEMORY_FIELDS = ("id", "namespace", "memory_type", "content", "source_event_id", "importance", "confidence", "metadata", "created_at", "updated_at", "valid_from", "valid_to", "deleted_at")
EVENT_FIELDS = ("id", "namespace", "actor", "text", "metadata", "created_at")


def escape(text: Column) -> Column:
    """Escapes backslash, tab, line ends, = and ; for a field of a tab-separated record."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, mark in ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit("\\" + mark))
    return out


def escaped_well(field: Column) -> Column:
    return field.rlike(r"^(?s:[^\\]|\\[\\tnres])*+$")


def unescape(field: Column) -> Column:
    """The inverse of ``escape``; null for a field that isn't escaped well.

    A backslash before another one always begins a pair, so pairs can be put aside first, as an escape that is not used.
    """
    out = F.replace(field, F.lit("\\\\"), F.lit("\\0"))
    for raw, mark in (*ESCAPES, ("\\", "0")):
        out = F.replace(out, F.lit("\\" + mark), F.lit(raw))
    return F.when(escaped_well(field), out)


def unhex_pairs(field: Column) -> Column:
    """The map of ``hex_pairs``; of equal keys the last one wins; null for what can't be decoded."""

    def plain(x: Column) -> Column:
        return F.try_validate_utf8(F.unhex(x).cast("string"))

    pairs = F.when(field == "", F.array().cast("array<string>")).otherwise(F.split(field, ";"))
    good = F.forall(pairs, lambda p: p.rlike("^([0-9a-fA-F]{2})*=([0-9a-fA-F]{2})*$"))
    sides = F.transform(pairs, lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("key"), plain(F.substring_index(p, "=", -1)).alias("value")))
    last = F.filter(sides, lambda p, i: ~F.exists(F.slice(sides, i + 2, F.size(sides)), lambda q: q["key"] == p["key"]))
    whole = F.forall(sides, lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    return F.when(good & whole, F.map_from_entries(F.when(good & whole, last)))


def seconds(time: Column) -> Column:
    """Whole epoch seconds as text; empty for null."""
    return F.coalesce(F.unix_seconds(time.cast("timestamp")).cast("string"), F.lit(""))


def line(kind: str, *fields: Column) -> Column:
    return F.concat_ws("\t", F.lit(kind), *[escape(F.coalesce(f, F.lit(""))) for f in fields])


def encode_event() -> Column:
    return line("event", F.col("id"), F.col("namespace"), F.col("actor"), F.col("text"), hex_pairs(F.col("metadata")), seconds(F.col("created_at")))


def encode_memory() -> Column:
    numbers = [F.format_string("%.6f", c) for c in ("importance", "confidence")]
    times = [seconds(F.col(c)) for c in MEMORY_FIELDS[8:]]
    return line("memory", *[F.col(c) for c in MEMORY_FIELDS[:5]], *numbers, hex_pairs(F.col("metadata")), *times, F.lit(""))


def encode_delete(id_: Column, at: Column) -> Column:
    return line("delete", id_, seconds(at))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line) of a log file, or of a folder of appended batches; ``seq`` orders the records."""
    rows = spark.read.text(path)
    batch = F.col("batch").cast("long") if "batch" in rows.columns else F.lit(0).cast("long")
    seq = F.struct(batch.alias("batch"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return rows.select(seq.alias("seq"), F.col("value").alias("line"))


def parse(lines: DataFrame) -> DataFrame:
    """(seq, kind, f, error) of (seq, line): decoded fields by name; ``error`` says why a record is corrupt.  Blank lines are skipped."""
    raw = F.split("line", "\t")
    rows = lines.filter(F.trim(F.regexp_replace("line", r"\s+", " ")) != "").select("seq", raw.alias("raw"))
    # as a generator's row, so that the optimizer does not unescape anew for each field that is read
    rows = rows.select("seq", F.inline(F.array(F.struct(F.transform("raw", unescape).alias("p"), F.exists("raw", lambda x: ~escaped_well(x)).alias("bad")))))
    rows = rows.withColumn("kind", F.get("p", F.lit(0)))

    def time(i: int) -> Column:
        return F.timestamp_seconds(F.get("p", F.lit(i)).try_cast("long"))

    def late(i: int) -> Column:
        return (F.coalesce(F.get("p", F.lit(i)), F.lit("")) != "") & F.get("p", F.lit(i)).try_cast("long").isNull()

    def at(i: int) -> Column:
        return F.get("p", F.lit(i))

    is_event, is_memory, is_delete = (F.col("kind") == k for k in ARITY)
    wrong = F.lit(None).cast("string")
    for kind, n in ARITY.items():
        wrong = F.coalesce(wrong, F.when((F.col("kind") == kind) & (F.size("p") != n), f"{kind} record must have {n} fields"))
    meta = F.when(is_event, unhex_pairs(at(5))).when(is_memory, unhex_pairs(at(8)))
    error = F.coalesce(
        F.when(F.col("bad"), "invalid escape"), wrong, F.when(~F.col("kind").isin(*ARITY), F.concat(F.lit("unknown record type: "), F.col("kind"))),
        F.when(is_memory & at(6).try_cast("double").isNull(), "invalid importance"), F.when(is_memory & at(7).try_cast("double").isNull(), "invalid confidence"),
        F.when((is_event | is_memory) & meta.isNull(), "invalid metadata"),
        F.when((is_event & time(6).isNull()) | (is_memory & (time(9).isNull() | time(10).isNull() | late(11) | late(12) | late(13))) | (is_delete & time(2).isNull()), "invalid timestamp"),
    )
    first = F.when(is_event, time(6)).when(is_memory, time(9)).when(is_delete, time(2))
    values = {
        "id": at(1), "namespace": at(2), "actor": F.when(is_event, at(3)), "text": F.when(is_event, at(4)), "memory_type": F.when(is_memory, memory_type(at(3))), "content": F.when(is_memory, at(4)),
        "source_event_id": F.when(is_memory, F.nullif(at(5), F.lit(""))), "importance": F.when(is_memory, at(6).try_cast("double")), "confidence": F.when(is_memory, at(7).try_cast("double")),
        "metadata": meta, "created_at": first, "updated_at": F.when(is_memory, time(10)), "valid_from": F.when(is_memory, time(11)), "valid_to": F.when(is_memory, time(12)), "deleted_at": F.when(is_memory, time(13)),
    }
    return rows.select("seq", "kind", F.struct(*[c.alias(k) for k, c in values.items()]).alias("f"), error.alias("error"))


def checked(parsed: DataFrame) -> DataFrame:
    """``parsed``; raises for the first corrupt record, with its line number."""
    first = parsed.filter("error is not null").orderBy("seq").select("seq", "error").first()
    if first is not None:
        place = F.struct(*[F.lit(v).alias(k) for k, v in first.seq.asDict().items()]).cast(parsed.schema["seq"].dataType)
        before = parsed.filter(F.col("seq") < place).count()
        raise CorruptStore(f"line {before + 1}: {first.error}")  # blank lines are not counted
    return parsed


def latest(records: DataFrame, key: str, seq: str) -> DataFrame:
    """The last record of each key; one aggregation with partial combining, no sort."""
    cols = [c for c in records.columns if c not in (key, seq)]
    return records.groupBy(key).agg(F.max_by(F.struct(seq, *cols), F.col(seq)).alias("r")).select(key, "r.*")


def replay_events(parsed: DataFrame) -> DataFrame:
    """The last version of every event."""
    return latest(parsed.filter("kind = 'event'").select("seq", *[f"f.{c}" for c in EVENT_FIELDS]), "id", "seq").select(*EVENT_FIELDS)


def replay_memories(parsed: DataFrame) -> DataFrame:
    """The last version of every memory; a later delete stamps it, deletes of unknown memories do nothing."""
    rows = parsed.filter("kind in ('memory', 'delete')").select("seq", "kind", "f.*")
    is_memory = F.col("kind") == "memory"
    kept = F.struct("seq", *MEMORY_FIELDS)
    both = rows.groupBy("id").agg(F.max_by(F.when(is_memory, kept), F.when(is_memory, F.col("seq"))).alias("m"), F.max_by(F.when(~is_memory, F.struct("seq", "created_at")), F.when(~is_memory, F.col("seq"))).alias("d"))
    both = both.filter("m is not null")
    stamp = F.when(F.col("d.seq") > F.col("m.seq"), F.col("d.created_at")).otherwise(F.col("m.deleted_at"))
    return both.select(*[F.col(f"m.{c}") for c in MEMORY_FIELDS[:-1]], stamp.alias("deleted_at"))


def visible(memories: DataFrame, namespace: str | None = None, types: list[str] | None = None, as_of: Column | None = None, side_channel: bool = True) -> DataFrame:
    """Filters of a listing: namespace, types (none: all), not deleted, valid at ``as_of``, side-channel rows."""
    out = memories.filter(F.col("deleted_at").isNull()) if "deleted_at" in memories.columns else memories
    if namespace is not None:
        out = out.filter(F.col("namespace") == namespace)
    if types:
        out = out.filter(F.col("memory_type").isin(types))
    if as_of is not None:
        out = out.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= as_of)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= as_of)))
    if not side_channel:
        out = out.filter(~F.coalesce(F.map_contains_key("metadata", F.lit("side_channel")), F.lit(False)))
    return out


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming records whose key is not there yet."""
    return incoming.join(existing.select(key), key, "left_anti")
