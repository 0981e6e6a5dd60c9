"""Evidence for answers: the best hits, and beside them original turns, neighbours, sessions, observations and profiles.

A question's hits are few (the pool of its search), so they travel as one array in its row; what is looked up beside them
comes by equi joins on conversation and source.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallforge.functions.text import overlap, terms
from recallforge.operators.answer import any_in
from recallforge.operators.ingest import neighbours
from recallforge.sources.log import visible

# Scores, sizes and words of the packs.
TURN_SCORE, SESSION_SCORE, WINDOW_SCORE, PROFILE_MORE = 0.45, 0.22, 0.30, 0.10
SOURCES, SESSIONS, PROMOTED = 3, 2, 0.20
PLACE_ASKED, PLACE_TOLD = ("where", "location", "live", "from"), (" in ", " at ", " from ", " lives ", " moved ")
RELATIONS = (
    (("job", "work", "career"), ("job", "work", "career", "occupation")), (("where", "location", "live", "moved"), ("location", "live", "moved")),
    (("prefer", "favorite", "like"), ("prefer", "favorite", "like")), (("when", "date", "year"), ("time", "date", "happened")),
)
PROFILE_ASKED = ("prefer", "preference", "favorite", "like", "want", "current", "latest", "previous", "what is", "what was", "where", "who", "job", "work", "degree", "relationship")
PROFILE_KINDS = ("preference", "attribute", "update", "temporal")
INTENT = {
    "preference": ("prefer", "preference", "favorite", "like", "want"), "update": ("current", "latest", "new", "now", "previous"),
    "temporal": ("when", "what year", "what date", "how long", "before", "after"), "attribute": ("who", "where", "what is", "what was", "job", "degree", "name"),
}
REPEATABLE = ("source_window", "verbatim_turn", "observation", "profile")
PACKET = "struct<id:string,content:string,memory_type:string,metadata:map<string,string>,importance:double,source_event_id:string,score:double,reasons:array<string>>"
FIELDS = ("id", "content", "memory_type", "metadata", "importance", "source_event_id", "score", "reasons")


@dataclass
class Pack:
    """What evidence is made of, by the pack's name; ``top_k`` hits are asked for."""

    name: str = "two-stage"
    top_k: int = 10
    answering: bool = True

    @property
    def observations(self) -> int:
        return {"primary": 0, "none": 0, "two-stage": 8}.get(self.name, 4)

    @property
    def sources(self) -> bool:
        return self.name in ("source", "source-first", "source-window", "expanded", "two-stage")

    @property
    def windows(self) -> bool:
        return self.name in ("source-window", "expanded", "two-stage")

    @property
    def sources_first(self) -> bool:
        return self.name in ("source-first", "two-stage")

    @property
    def primary_limit(self) -> int:
        return max(self.top_k, 200) if self.name == "two-stage" else min(self.top_k, 10)

    @property
    def search_limit(self) -> int:
        if not self.answering:
            return self.top_k
        return max(self.top_k, 200 if self.name == "two-stage" else 50)


def packet(score: Column, reason: str) -> Column:
    """A memory's row as a packet."""
    given = {"score": score.cast("double"), "reasons": F.array(F.lit(reason)), "importance": F.col("importance").cast("double"), "id": F.col("id").cast("string")}
    return F.struct(*[given.get(f, F.col(f)).alias(f) for f in FIELDS]).cast(PACKET)


def candidates(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, candidates): hits (query_id, id, score, rank, reasons) with their memories, in the order of rank."""
    rows = hits.select("query_id", "id", "rank", F.col("score").alias("s"), F.col("reasons").alias("r")).join(memories, "id")
    each = F.struct(F.col("id").cast("string").alias("id"), "content", "memory_type", "metadata", F.col("importance").cast("double").alias("importance"), "source_event_id", F.col("s").cast("double").alias("score"), F.col("r").alias("reasons")).cast(PACKET)
    ordered = F.array_sort(F.collect_list(F.struct("rank", each.alias("p"))), lambda a, b: a["rank"] - b["rank"])
    return rows.groupBy("query_id").agg(F.transform(ordered, lambda x: x["p"]).alias("candidates"))


# ---- the best hits


def relation_fits(question: str, relation: str) -> bool:
    low = relation.lower()
    return low in question or any(any_in(question, a) and any_in(low, b) for a, b in RELATIONS)


def structured_bonus(question: str, p: dict) -> float:
    """How much a memory promises an answer: places for where-questions, or subject and relation of a structured memory."""
    q, content, meta = question.lower(), p["content"].lower(), dict(p["metadata"] or ())
    shared = overlap(question, p["content"]) > 0
    if any_in(q, PLACE_ASKED) and any_in(content, PLACE_TOLD) and shared:
        return 0.2
    if meta.get("memory_kind") not in ("llm_fact", "observation", "profile"):
        return 0.0
    subject, relation = meta.get("subject"), meta.get("relation")
    return round(0.12 * (subject is not None and subject.lower() in q) + 0.12 * (relation is not None and relation_fits(q, relation)) + 0.08 * shared, 6)


def primary(question: str, pool: list[dict], limit: int) -> list[dict]:
    """The first ``limit`` hits; the last of them gives way to a later one of a new source that promises an answer.

    Of the two later hits that promise most, the second one that is accepted takes the place of the first.
    """
    taken, later = pool[:limit], pool[limit:]
    sources = {p["source_event_id"] for p in taken} - {None}
    best = sorted(((b, p) for p in later if (b := structured_bonus(question, p)) >= PROMOTED), key=lambda x: -x[0])[: min(limit, 2)]
    for _, p in best:
        if taken and (p["source_event_id"] is None or p["source_event_id"] not in sources):
            sources.add(p["source_event_id"])
            taken = [*taken[:-1], {**p, "reasons": [*(p["reasons"] or ()), "structured_answer_promotion"]}]
    return taken


# ---- the order in which all is put together


def assembled(first: list[dict], beside: list[dict], pack: Pack) -> list[dict]:
    """Hits and what was found beside them: a memory once, a source again only for some kinds; then by source and content."""
    out = [] if pack.sources_first else list(first)
    ids, sources = {p["id"] for p in out}, {p["source_event_id"] for p in out} - {None}
    queue = beside
    if pack.sources_first:  # hits come after turns, windows and sessions, before profiles and observations
        n = next((i for i, p in enumerate(beside) if "side_channel_late" in p["reasons"]), len(beside))
        queue = [*beside[:n], *first, *beside[n:]]
    for p in queue:
        if p["id"] in ids:
            continue
        ids.add(p["id"])
        source, kind = p["source_event_id"], dict(p["metadata"] or ()).get("memory_kind")
        if source is None or source not in sources or (pack.sources and kind in REPEATABLE):
            sources.add(source)
            out.append({**p, "reasons": [r for r in p["reasons"] if r != "side_channel_late"]})
    return in_order(out)


def in_order(evidence: list[dict]) -> list[dict]:
    """Of equal contents the one with the best score, the first of equal ones; by source (none first) and content."""
    best: dict[str, dict] = {}
    for p in evidence:
        if p["content"] not in best or p["score"] > best[p["content"]]["score"]:
            best[p["content"]] = p
    return sorted(best.values(), key=lambda p: (p["source_event_id"] is not None, (p["source_event_id"] or "").encode(), p["content"].encode()))


def _mapped(rows: DataFrame, columns: list[str], schema: str, make) -> DataFrame:
    """A map over rows that keeps the first column and gives one array of packets."""
    kind = rows.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [make(*(v if v is not None else [] for v in r)) for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
            # every task gives the type of its input's packets
            like = next(batch.schema.field(c).type for c in columns if pa.types.is_list(batch.schema.field(c).type))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(values, like)], names=["query_id", schema])

    return rows.select("query_id", *columns).mapInArrow(run, f"query_id {kind}, {schema} array<{PACKET}>")


def evidence(questions: DataFrame, pools: DataFrame, memories: DataFrame, turns: DataFrame, pack: Pack | None = None, side_channel: bool = True) -> DataFrame:
    """(query_id, evidence) of questions (query_id, conversation_id, text) with pools (query_id, candidates).

    ``memories`` are all of the store, ``turns`` (conversation_id, turn_index, id, speaker, text, timestamp) those of the
    dataset.  Observations are side-channel memories; ``side_channel=False`` leaves them and profiles out.
    """
    pack = pack or Pack()
    asked = questions.select("query_id", F.col("conversation_id").alias("namespace"), "text").join(pools, "query_id", "left")
    limit = pack.primary_limit
    first = _mapped(asked, ["text", "candidates"], "first", lambda q, pool: primary(q or "", pool, limit))
    if pack.observations == 0 and not pack.sources:
        return first.withColumnRenamed("first", "evidence")
    asked = asked.select("query_id", "namespace", "text").join(first, "query_id")
    seen = visible(memories, side_channel=True)
    sources = asked.select("query_id", "namespace", F.posexplode(F.filter(F.transform("first", lambda p: p["source_event_id"]), lambda s: s.isNotNull())).alias("at", "source"))
    near = sources.filter(f"at < {SOURCES}").groupBy("query_id", "namespace", "source").agg(F.min("at").alias("at"))
    kind = F.col("metadata")["memory_kind"]
    parts = []

    def add(rows: DataFrame, step: int, order: list[Column], limit: int | None) -> None:
        """Packets (query_id, p) of a step, in their order."""
        got = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("p.id").alias("pid"), F.to_json("p").alias("j")))).alias("x"))
        some = F.slice("x", 1, limit) if limit is not None else F.col("x")
        parts.append(got.select("query_id", F.posexplode(some).alias("k", "x")).select("query_id", F.lit(step).alias("step"), "k", F.from_json("x.j", PACKET).alias("p")))

    plain = F.coalesce(F.col("metadata")["verbatim_form"] == "turn_text", F.lit(False))
    said = seen.filter((kind == "verbatim_turn") & (F.col("memory_type") == "episodic")).join(near.withColumnRenamed("source", "source_event_id"), ["namespace", "source_event_id"])
    add(said.select("query_id", plain.cast("int").alias("plain"), packet(F.lit(TURN_SCORE), "verbatim_turn_evidence").alias("p")), 0, [F.col("plain"), -F.col("p.importance")], SOURCES)
    if pack.windows:
        add(window_packets(near, turns), 1, [F.col("at"), F.col("turn_index")], None)
    if pack.sources:
        held = seen.filter((kind == "verbatim_session") & (F.col("memory_type") == "episodic")).withColumn("source", F.explode(F.split(F.col("metadata")["source_turn_ids"], "\n")))
        whole = held.join(sources.select("query_id", "namespace", "source").distinct(), ["namespace", "source"]).dropDuplicates(["query_id", "id"])
        add(whole.select("query_id", packet(F.lit(SESSION_SCORE), "verbatim_session_side_channel").alias("p")), 2, [F.lit(0)], SESSIONS)
    if side_channel and pack.observations:
        noted = observation_packets(asked.select("query_id", "namespace", "text"), seen)
        add(profile_packets(noted, min(pack.observations, 2)), 3, [F.col("k")], None)
        add(noted.select("query_id", "p"), 4, [-F.col("p.score")], pack.observations)
    beside = parts[0]
    for part in parts[1:]:
        beside = beside.unionByName(part)
    late = F.when(F.col("step") >= 3, F.array_append("p.reasons", F.lit("side_channel_late"))).otherwise(F.col("p.reasons"))
    rows = beside.withColumn("p", F.col("p").withField("reasons", late)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("step", "k", F.to_json("p").alias("j")))).alias("x"))
    rows = rows.select("query_id", F.transform("x", lambda x: F.from_json(x["j"], PACKET)).alias("beside"))
    joined = first.join(rows, "query_id", "left").withColumn("beside", F.coalesce("beside", F.array().cast(f"array<{PACKET}>")))
    return _mapped(joined, ["first", "beside"], "evidence", lambda a, b: assembled(a, b, pack))


def window_packets(near: DataFrame, turns: DataFrame, radius: int = 1) -> DataFrame:
    """(query_id, at, turn_index, p): turns beside the sources (query_id, namespace, source, at), each by the first source that it is near."""
    t = turns.select(F.col("conversation_id").alias("namespace"), "turn_index", "id", "speaker", "text", "timestamp")
    here = near.join(t.select("namespace", F.col("id").alias("source"), "turn_index"), ["namespace", "source"])
    beside = neighbours(t.select("namespace", F.col("turn_index").alias("seq")), radius).select("namespace", F.col("seq").alias("turn_index"), "near", "distance")
    rows = here.join(beside, ["namespace", "turn_index"]).groupBy("query_id", "namespace", "near").agg(F.min(F.struct("at", "distance")).alias("m"))
    rows = rows.select("query_id", "namespace", F.col("near").alias("turn_index"), "m.at", "m.distance").join(t, ["namespace", "turn_index"])
    time = F.when(F.col("timestamp").isNotNull(), F.concat(F.lit(" time="), "timestamp")).otherwise("")
    content = F.concat(F.lit("[source_window distance="), F.col("distance").cast("string"), time, F.lit("] "), "speaker", F.lit(": "), "text")
    meta = F.create_map(F.lit("memory_kind"), F.lit("source_window"), F.lit("speaker"), F.col("speaker"))
    meta = F.when(F.col("timestamp").isNotNull(), F.map_concat(meta, F.create_map(F.lit("event_time"), F.col("timestamp")))).otherwise(meta)
    made = rows.withColumns({"source_event_id": F.col("id"), "id": F.concat(F.lit("window_"), "id"), "content": content, "metadata": meta, "memory_type": F.lit("episodic"), "importance": F.lit(0.52)})
    return made.select("query_id", "at", "turn_index", packet(F.lit(WINDOW_SCORE) / F.greatest("distance", F.lit(1)), "source_window_side_channel").alias("p"))


def observation_packets(asked: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, text, p): observations of a question's conversation that have anything to do with it.

    Their score is the overlap of terms, more if their kind is asked for and for every entity that the question names.
    """
    noted = memories.filter((F.col("metadata")["memory_kind"] == "observation") & (F.col("memory_type") == "semantic"))
    rows = noted.join(asked, "namespace").withColumns({"a": F.array_distinct(terms("text")), "b": F.array_distinct(terms("content")), "low": F.lower("text")})
    score = F.when((F.size("a") == 0) | (F.size("b") == 0), 0.0).otherwise(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")))
    kind, wanted = F.col("metadata")["observation_kind"], F.lit(False)
    for name, words in INTENT.items():
        found = F.lit(False)
        for w in words:
            found = found | F.contains("low", F.lit(w))
        wanted = wanted | ((kind == name) & found)
    named = F.filter(F.split(F.coalesce(F.col("metadata")["entities"], F.lit("")), "\n"), lambda e: (F.octet_length(e) > 2) & F.contains("low", e))
    total = score + F.when(wanted, 0.35).otherwise(0.0) + F.size(named) * 0.2
    return rows.withColumn("total", total).filter("total > 0").select("query_id", "text", packet(F.col("total"), "observation_side_channel").alias("p"))


def profile_packets(noted: DataFrame, limit: int) -> DataFrame:
    """(query_id, k, p): the best observations of a question about a person's profile, as profile statements."""
    asked = F.lit(False)
    for w in PROFILE_ASKED:
        asked = asked | F.contains(F.lower("text"), F.lit(w))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("p.score")).alias("s"), F.col("p.id").alias("pid"), F.to_json("p").alias("j")))), 1, limit * 3)
    rows = noted.filter(asked).groupBy("query_id").agg(best.alias("x")).withColumn("x", F.transform("x", lambda x: F.from_json(x["j"], PACKET)))
    rows = rows.select("query_id", F.posexplode(F.slice(F.filter("x", lambda p: p["metadata"]["observation_kind"].isin(*PROFILE_KINDS)), 1, limit)).alias("k", "o"))
    meta = F.col("o.metadata")
    relation = F.coalesce(meta["relation"], F.lit("attribute"))
    content = F.format_string("[profile] %s %s: %s", F.coalesce(meta["subject"], F.lit("user")), relation, F.coalesce(meta["object"], F.col("o.content")))
    made = rows.withColumns({
        "id": F.concat(F.lit("profile_"), "o.id"), "content": content, "memory_type": F.lit("semantic"), "importance": F.lit(0.8), "source_event_id": F.col("o.source_event_id"),
        "metadata": F.create_map(F.lit("memory_kind"), F.lit("profile"), F.lit("profile_relation"), relation),
    })
    return made.select("query_id", "k", packet(F.col("o.score") + PROFILE_MORE, "profile_side_channel").alias("p"))
