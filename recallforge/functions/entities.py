"""Names in texts: quoted spans, runs of capitalised words, links from entities to memories."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Capitalised words that name nothing.
COMMON = (
    "What", "When", "Where", "Who", "How", "Did", "Does", "Is", "Are", "Was", "Were", "Which", "Whose", "Whom", "The", "A", "An", "This", "That",
    "These", "Those", "My", "Your", "His", "Her", "Our", "Their", "It", "Its", "I", "You", "He", "She", "We", "They", "And", "But", "Or", "For", "Nor",
    "So", "Yet", "In", "On", "At", "To", "From", "By", "With", "About", "Into", "Through", "During", "Before", "After", "Above", "Below", "Between",
    "Under", "Over", "Of", "Can", "Will", "Would", "Could", "Should", "May", "Might", "Must", "Not", "No", "Yes", "If", "Then", "Else", "While", "Since",
    "Just", "Only", "Also", "Still", "Even", "Very", "Too", "All", "Some", "Any", "Each", "Every", "Both", "Few", "Many", "More", "Most",
)
_EDGES = re.compile("^[^A-Za-z0-9]+|[^A-Za-z0-9]+$")
_QUOTES = re.compile("[\"“”]")
_TITLE = re.compile("[A-Z][a-z]*|[A-Z]{2,}")


def _proper(word: str) -> bool:
    return len(word) > 1 and "A" <= word[0] <= "Z" and word not in COMMON


def _title(word: str) -> bool:
    return _TITLE.fullmatch(word) is not None and word not in COMMON


def _runs(words: list[tuple[int, str]], fits: Callable[[str], bool]) -> list[list[str]]:
    """Words that fit, in runs of neighbouring places."""
    out, last = [], None
    for i, w in words:
        if fits(w):
            if last is not None and i == last + 1:
                out[-1].append(w)
            else:
                out.append([w])
            last = i
    return out


def names(text: str | None) -> set[str]:
    """Lower-cased entities of a text: quoted spans, runs of capitalised words and their parts."""
    if not text:
        return set()
    quoted = (q.strip() for q in _QUOTES.split(text)[1:-1:2])
    out = {q.lower() for q in quoted if len(q.encode()) > 1 and q.strip(string.punctuation)}
    # words in lower case name nothing, and are most of a text
    words = [(i, _EDGES.sub("", w)) for i, w in enumerate(text.split()) if not w.islower()]
    for run in _runs(words, _proper):
        out.update(w.lower() for w in (*run, " ".join(run)))
    out.update(" ".join(run).lower() for run in _runs(words, _title) if len(run) > 1)
    return out


def text_names(text: str | None) -> set[str]:
    """Entities of a text and of each of its sentences, which may break a run."""
    return names(text).union(*(names(s) for s in re.split("[.!?]", text or "") if s and not s.islower()))


def memory_names(content: str | None, held: str | None = None, subject: str | None = None, object_: str | None = None) -> list[str]:
    """Sorted entities that a memory is stored with: of its content, those it has (one a line), of its subject and object."""
    out = text_names(content) | {h.strip().lower() for h in (held or "").split("\n") if h.strip()}
    for value in (subject, object_):
        if value is not None:
            out |= text_names(value) | ({value.lower()} if len(value.encode()) > 1 else set())
    return sorted(out)


@F.pandas_udf(ArrayType(StringType()))
def entities(text: pd.Series) -> pd.Series:
    """Sorted entities of texts."""
    return text.map(lambda t: sorted(text_names(t)))


@F.pandas_udf(ArrayType(StringType()))
def enriched(content: pd.Series, held: pd.Series, subject: pd.Series, object_: pd.Series) -> pd.Series:
    return pd.Series([memory_names(*row) for row in zip(content, held, subject, object_, strict=True)], dtype=object)


def enrich(memories: DataFrame) -> DataFrame:
    """``memories`` with ``metadata.entities`` set to the sorted entities, one a line, where there are any."""
    at = [F.col("metadata")[k] for k in ("entities", "subject", "object")]
    found = memories.withColumn("_found", enriched("content", *at))
    rest = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != "entities")
    joined = F.map_concat(rest, F.create_map(F.lit("entities"), F.array_join("_found", "\n")))
    return found.withColumn("metadata", F.when(F.size("_found") > 0, joined).otherwise(rest)).drop("_found")


def held_entities(metadata: Column) -> Column:
    """The stored entities as a lower-cased array; empty without any."""
    parts = F.transform(F.split(F.coalesce(metadata["entities"], F.lit("")), "\n"), lambda e: F.lower(F.trim(e)))
    return F.array_distinct(F.filter(parts, lambda e: e != ""))


def entity_links(memories: DataFrame) -> DataFrame:
    """(entity, id): the inverted index of stored entities."""
    return memories.select("id", F.explode(held_entities(F.col("metadata"))).alias("entity")).select("entity", "id").distinct()


def linked_memories(links: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id): memories that share an entity with the arrays of ``asked`` (query_id, entities)."""
    return links.join(asked.select("query_id", F.explode("entities").alias("entity")).distinct(), "entity").select("query_id", "id").distinct()
