"""The engine: a store, extraction, merges on write, search and contexts, in batches."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallforge import schema
from recallforge.functions.embedding import EmbeddingProvider
from recallforge.operators import extract, ingest, retrieve, search
from recallforge.providers import LlmProvider
from recallforge.schema import MemoryQuery
from recallforge.sources.log import visible
from recallforge.sources.shared import materialize
from recallforge.sources.store import MemoryStore


class MemoryEngine:
    """Memories of events in a store.

    ``buffer`` is the number of turns of a window, if memories are to be extracted from windows instead of single turns;
    ``provider`` an external embedding; ``extractor`` a language model, instead of the rules.
    """

    def __init__(self, store: MemoryStore, provider: EmbeddingProvider | None = None, buffer: int | None = None, extractor: LlmProvider | None = None):
        if buffer is not None and buffer < 1:
            raise ValueError("a buffer has one turn at least")
        self.store, self.provider, self.buffer, self.extractor = store, provider, buffer, extractor

    def add_events(self, events: DataFrame) -> None:
        """Stores events as they are."""
        self.store.add_events(schema.events(events, self.store.now))

    def extract(self, turns: DataFrame) -> DataFrame:
        """Candidates of turns (namespace, event_id, actor, text, seq), by model or rules, of windows if there is a buffer."""
        if self.buffer is not None:
            w = ingest.windows(turns, self.buffer)
            turns = w.select("namespace", schema.stable_id("win", F.col("namespace"), F.col("window"), F.col("full")).alias("event_id"), F.lit("multi-turn").alias("actor"), F.col("combined").alias("text"))
        return extract.llm_candidates(turns, self.extractor) if self.extractor else ingest.candidates(turns)

    def ingest(self, events: DataFrame) -> DataFrame:
        """Stores events and the memories that they give; returns the memories that were written.  Events are taken in the order of time and id."""
        rows = schema.events(events, self.store.now)
        self.store.add_events(rows)
        order = F.row_number().over(Window.partitionBy("namespace").orderBy("created_at", "id")).cast("long")
        turns = rows.select("namespace", F.col("id").alias("event_id"), "actor", "text", "created_at", "id").withColumn("seq", order)
        found = self.extract(turns.select("namespace", "event_id", "actor", "text", "seq"))
        if self.buffer is None:
            found = found.join(turns.select("namespace", "event_id", "seq"), ["namespace", "event_id"]).withColumn("seq", F.col("seq") * 1_000_000 + F.col("pos"))
        else:
            found = found.withColumn("seq", F.row_number().over(Window.partitionBy("namespace").orderBy("event_id", "pos")).cast("long"))
        return self.remember(extract.with_ids(found).join(found.select(schema.stable_id("mem", F.col("event_id"), F.col("pos"), F.col("content")).alias("id"), "seq"), "id"))

    def remember(self, memories: DataFrame) -> DataFrame:
        """Merges memories, in the order of ``seq``, into those of the store; returns what was written.

        Stored memories of the same namespace and type come first, in the order of their ids.  Without ``seq`` the order is
        that of a digest of the content.
        """
        given = memories if "seq" in memories.columns else memories.withColumn("seq", F.expr("shiftrightunsigned(xxhash64(content), 1)"))
        new = schema.memories(given.drop("seq"), self.store.now).join(given.select("id", "seq"), "id") if "id" in given.columns else self._numbered(given)
        new = new.persist()
        held = visible(self.store.memories(), as_of=self.store.now, side_channel=False).join(new.select("namespace", "memory_type").distinct(), ["namespace", "memory_type"], "left_semi").persist()
        place = F.row_number().over(Window.partitionBy("namespace", "memory_type").orderBy("id")).cast("long") - F.lit(1 << 50)
        columns = ["id", "namespace", "memory_type", "content", "source_event_id", "importance", "confidence", "metadata", "seq"]
        folded = materialize(ingest.fold(held.withColumn("seq", place).select(*columns).unionByName(new.select(*columns))), "folded")
        old = held.select("id", F.lit(True).alias("known"), "created_at", "valid_from", "valid_to")
        fresh = new.select("id", F.col("created_at").alias("new_at"), F.col("valid_from").alias("new_from"), F.col("valid_to").alias("new_to"))
        rows = folded.join(old, "id", "left").join(fresh.dropDuplicates(["id"]), "id", "left").filter("known is null or merged > 1")
        # persisted, as the caller reads it after the store has changed
        written = rows.select(
            *columns[:-1], F.coalesce("created_at", "new_at").alias("created_at"), self.store.now.alias("updated_at"), F.when(F.col("known"), F.col("valid_from")).otherwise(F.col("new_from")).alias("valid_from"),
            F.when(F.col("known"), F.col("valid_to")).otherwise(F.col("new_to")).alias("valid_to"), F.lit(None).cast("timestamp").alias("deleted_at"),
        ).persist()
        self.store._append("memory", written)
        held.unpersist()  # a later reading of the store must not find it
        new.unpersist()
        return written

    def _numbered(self, given: DataFrame) -> DataFrame:
        rows = given.withColumn("id", schema.stable_id("mem", *[F.col(c) for c in given.columns if c != "metadata"]))
        return schema.memories(rows.drop("seq"), self.store.now).join(rows.select("id", "seq"), "id")

    def search(self, queries: list[MemoryQuery]) -> DataFrame:
        """(query_id, id, source, score, signals, rank, reasons, memory columns) of queries, by their place in the list.

        Queries with the same filters are one search over the memories that these leave.
        """

        def filters(item: tuple[int, MemoryQuery]) -> tuple:
            q = item[1]
            return (q.limit, tuple(sorted(q.memory_types)), q.include_expired, q.include_side_channel)

        out, spark, held = None, self.store.spark, self.store.memories()
        for (limit, types, expired, side), group in groupby(sorted(enumerate(queries), key=filters), filters):
            seen = visible(held, None, list(types) or None, None if expired else self.store.now, side)
            asked = spark.createDataFrame([(i, q.namespace, q.text) for i, q in group], "query_id long, namespace string, text string")
            hits = search.search(seen, asked, search.Search(limit=limit, provider=self.provider)).withColumn("reasons", search.reasons())
            rows = hits.join(seen.select("id", "content", "memory_type", "metadata", "importance", "confidence", "source_event_id"), "id")
            out = rows if out is None else out.unionByName(rows)
        return out

    def build_context(self, query: MemoryQuery) -> str:
        """The memories for a query as a text; empty if there are none."""
        row = retrieve.build_context(self.search([query])).first()
        return row.context if row else ""

    def delete_memories(self, namespace: str, ids: list[str]) -> None:
        """Deletes memories of a namespace; an id that is not there is an error."""
        self.store.delete_in(namespace, self.store.spark.createDataFrame([(i,) for i in ids], "id string"))
