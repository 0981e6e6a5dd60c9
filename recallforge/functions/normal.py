"""Normal forms for lenient judging, and single signals of the hybrid score, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words in order from 0, articles, ordinal suffixes, and factors of memory kinds.
NUMBERS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty",
)
ARTICLES = ("a", "an", "the")
ORDINAL = "(st|nd|rd|th)$"
KIND_FACTORS = {"verbatim_turn": 1.2, "verbatim_session": 0.3, "llm_fact": 1.1, "observation": 1.0}
OTHER_KIND = 0.8


def lenient(text: Column) -> Column:
    """ASCII letters and digits in lower case, without articles and ordinal suffixes, number words as digits."""
    digits = F.create_map(*[F.lit(x) for i, word in enumerate(NUMBERS) for x in (word, str(i))])
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*ARTICLES))
    bare = F.transform(words, lambda w: F.regexp_replace(w, ORDINAL, ""))
    return F.array_join(F.transform(bare, lambda w: F.coalesce(digits[w], w)), " ")


def turn_index(source: Column) -> Column:
    """The last part between underscores that is an unsigned number; null without one."""
    numbers = F.filter(F.split(source, "_"), lambda p: p.rlike(r"^\+?[0-9]+$"))
    return F.try_element_at(numbers, F.lit(-1)).try_cast("long")


def kind_factor(kind: Column) -> Column:
    out = F
    for name, factor in KIND_FACTORS.items():
        out = out.when(kind == name, factor)
    return out.otherwise(OTHER_KIND)


def speaker_match(question: Column, speaker: Column) -> Column:
    """1 if the question holds the speaker's name in any case, else 0."""
    name = F.lower(F.coalesce(speaker, F.lit("")))
    return F.when((name != "") & F.contains(F.lower(F.coalesce(question, F.lit(""))), name), 1.0).otherwise(0.0)


def entity_boost(asked: Column, held: Column) -> Column:
    """Half a point for each shared entity, 1.2 at most."""
    return F.least(F.size(F.array_intersect(asked, held)) * 0.5, F.lit(1.2))


def prefix_bonus(asked: Column, held: Column) -> Column:
    """Mean over the asked tokens of the best match: 1 if equal, 0.5 if one begins the other and both have 4 bytes."""

    def match(a: Column, b: Column) -> Column:
        begins = (F.octet_length(a) >= 4) & (F.octet_length(b) >= 4) & (F.startswith(a, b) | F.startswith(b, a))
        return F.when(a == b, 1.0).when(begins, 0.5).otherwise(0.0)

    best = F.transform(asked, lambda a: F.coalesce(F.array_max(F.transform(held, lambda b: match(a, b))), F.lit(0.0)))
    total = F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(asked) > 0, total / F.size(asked)).otherwise(0.0)
