"""Observations: one typed statement a sentence, by ordered rules, as side-channel memories."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallforge.functions.text import stemmed
from recallforge.schema import stable_id

# Words that start sentences but name nothing, rewritings of the first person, phrases of the rules,
# and importance and confidence by kind.
STARTS = ("I", "I'm", "My", "The", "A", "An", "It", "This", "That", "When", "What", "Where", "How")
FIRST_PERSON = (
    (" I'm ", "is"), (" I am ", "is"), (" I've ", "has"), (" I have ", "has"), (" I prefer ", "prefers"), (" I like ", "likes"), (" I love ", "loves"),
    (" I dislike ", "dislikes"), (" I want ", "wants"), (" I work ", "works"), (" I live ", "lives"), (" I moved ", "moved"), (" I graduated ", "graduated"),
)
BUYING = ("bought", "buy", "purchased", "got")
UNITS = ("mbps", "gbps")
PREFERENCES = ("i prefer", "i like", "i love", "i dislike", "favorite", "rather", "want to", "looking for")
ATTRIBUTES = ("my name is", "call me", "i am", "i'm", "i work", "i live", "i moved", "i graduated", "my current", "my previous", "my new")
CHANGES = ("current", "previous", "new", "now", "changed")
TIMES = ("when", "last", "next", "ago", "before", "after", "today", "yesterday", "tomorrow")
IMPORTANCE = {"preference": 0.58, "update": 0.58, "temporal": 0.54, "attribute": 0.54, "assistant_fact": 0.50, "event": 0.45}
CONFIDENCE = {"preference": 0.62, "attribute": 0.62, "update": 0.62, "temporal": 0.58, "assistant_fact": 0.55, "event": 0.50}
PROFILE = (0.56, 0.64)
_CLAUSE_END = re.compile("[,.;\n]")


def any_of(text: str, words: tuple[str, ...]) -> bool:
    return any(w in text for w in words)


def tidy(value: str) -> str:
    """Without marks at the ends, with single spaces."""
    return " ".join(value.strip().strip(":-,.").split())


def after(sentence: str, *patterns: str) -> str | None:
    """What follows the first of the patterns that something follows, to the end of the clause; case does not matter."""
    for p in patterns:
        found = re.search(re.escape(p), sentence, re.I)
        value = tidy(_CLAUSE_END.split(sentence[found.end() :], maxsplit=1)[0]) if found else ""
        if value:
            return value
    return None


def around_unit(sentence: str) -> str | None:
    """The word before a unit, the unit, and the word after it."""
    words = sentence.split()
    for i, w in enumerate(words):
        if re.sub("^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", w).lower() in UNITS:
            return tidy(" ".join(words[max(i - 1, 0) : i + 2]))
    return None


def capitalised(sentence: str) -> list[str]:
    """Runs of words that begin with a capital, without common starts of sentences."""
    words = [re.sub("^[^A-Za-z0-9']+|[^A-Za-z0-9']+$", "", w) for w in sentence.split()]
    runs = [" ".join(run) for name, run in groupby(words, lambda w: "A" <= w[:1] <= "Z" and w not in STARTS) if name]
    return [r for r in runs if len(r) > 1]


def third_person(sentence: str, subject: str) -> str:
    text = f" {sentence} "
    for said, verb in FIRST_PERSON:
        text = text.replace(said, f" {subject} {verb} ")
    return tidy(text.replace(" my ", f" {subject}'s ").replace(" My ", f" {subject}'s "))


def actor_name(actor: str) -> str:
    low = actor.lower()
    if "user" in low or "human" in low:
        return "user"
    return "assistant" if "assistant" in low or "agent" in low else actor


def subject_of(sentence: str, actor: str) -> str:
    if any_of(sentence.lower(), (" i ", "i'm", "i am", " my ")):
        return "user"
    return next(iter(capitalised(sentence)), None) or actor_name(actor)


def _preference(low: str) -> str:
    for words, relation in ((("dislike",), "dislikes"), (("favorite",), "has_favorite"), (("want", "looking for"), "wants")):
        if any_of(low, words):
            return relation
    return "prefers"


def _attribute(low: str) -> str:
    for words, relation in ((("graduated", "degree"), "education"), (("work", "role", "job"), "work"), (("live", "moved"), "location"), (("name", "call me"), "identity")):
        if any_of(low, words):
            return relation
    return "attribute"


def _gift(s: str, low: str, who: str) -> tuple[str, str, str | None]:
    value = after(s, " from my ", " from user's ", " from ")
    return "attribute", "gift_from", value and f"from {value}"


#: In this order: whether a rule is for a sentence (in lower case), and the kind, relation and object that it gives.
_RULES: tuple[tuple[Callable[[str], bool], Callable[[str, str, str], tuple[str, str, str | None]]], ...] = (
    (lambda low: "gift" in low and " from " in low, _gift),
    (lambda low: "redeem" in low and "coupon" in low, lambda s, low, who: ("attribute", "redeemed_at", after(s, " at ", " from "))),
    (lambda low: any_of(low, BUYING) and " from " in low, lambda s, low, who: ("attribute", "purchase_location", after(s, " from ", " at "))),
    (lambda low: any_of(low, UNITS), lambda s, low, who: ("attribute", "quantity", around_unit(s))),
    (lambda low: any_of(low, PREFERENCES), lambda s, low, who: ("preference", _preference(low), after(s, " favorite ", " favorite is ", " is ") if "favorite" in low else third_person(s, who))),
    (lambda low: any_of(low, ATTRIBUTES), lambda s, low, who: ("update" if any_of(low, CHANGES) else "attribute", _attribute(low), third_person(s, who))),
    (lambda low: any_of(low, TIMES), lambda s, low, who: ("temporal", "happened_at_or_near", third_person(s, who))),
)


def observe(sentence: str, actor: str) -> dict | None:
    """The observation of a sentence of 3 words to 360 characters: the first rule for it decides; objects have two words at least."""
    if len(sentence.split()) < 3 or len(sentence) > 360:
        return None
    low = sentence.lower()
    rule = next((make for fits, make in _RULES if fits(low)), None)
    if rule is None:
        return None
    who = subject_of(sentence, actor)
    kind, relation, object_ = rule(sentence, low, who)
    if object_ is None or len(object_.split()) < 2:
        return None
    tokens = [t for name in (*capitalised(sentence), who) for t in stemmed(name) if len(t.encode()) > 1]
    return {"kind": kind, "subject": who, "relation": relation, "object": object_, "entities": list(dict.fromkeys(tokens))}


_SCHEMA = "namespace string, event_id string, pos int, kind string, subject string, relation string, object string, entities array<string>, event_time string"


def observations(turns: DataFrame) -> DataFrame:
    """Observations of all sentences of turns (namespace, event_id, actor, text, and time as ``timestamp`` if there is one)."""
    time = F.nullif(F.col("timestamp"), F.lit("")) if "timestamp" in turns.columns else F.lit(None).cast("string")
    rows = turns.select("namespace", "event_id", F.coalesce("actor", F.lit("user")).alias("actor"), F.coalesce("text", F.lit("")).alias("text"), time.alias("event_time"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [p.split(" ")[0] for p in _SCHEMA.split(", ")]
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                parts = [p.strip() for p in re.split("[.!?\n]", r.text)]
                for pos, s in enumerate(p for p in parts if p):
                    if o := observe(s, r.actor):
                        out.append({"namespace": r.namespace, "event_id": r.event_id, "pos": pos, **o, "event_time": r.event_time})
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(found, _SCHEMA)


def as_memories(observed: DataFrame, profile: bool = False) -> DataFrame:
    """Observations as semantic side-channel memories; or, all but facts of the assistant and events, as profile memories."""

    def by_kind(values: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("kind")]

    pairs = {"memory_kind": F.lit("profile" if profile else "observation"), **({} if profile else {"side_channel": F.lit("observation"), "observation_kind": F.col("kind")})}
    pairs |= {c: F.col(c) for c in ("subject", "relation", "object")} | {"entities": F.array_join("entities", "\n")}
    meta = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    timed = F.when(F.col("event_time").isNotNull(), F.map_concat(meta, F.create_map(F.lit("event_time"), F.col("event_time")))).otherwise(meta)
    if profile:
        content, importance, confidence = F.format_string("[profile] %s %s: %s", "subject", "relation", "object"), F.lit(PROFILE[0]), F.lit(PROFILE[1])
        observed = observed.filter(~F.col("kind").isin("assistant_fact", "event"))
    else:
        content, importance, confidence = F.format_string("[%s] %s %s %s", "kind", "subject", "relation", "object"), by_kind(IMPORTANCE), by_kind(CONFIDENCE)
    return observed.select(
        stable_id("prof" if profile else "obs", F.col("event_id"), F.col("pos")).alias("id"), "namespace", F.lit("semantic").alias("memory_type"), content.alias("content"),
        F.col("event_id").alias("source_event_id"), importance.alias("importance"), confidence.alias("confidence"), timed.alias("metadata"),
    )
