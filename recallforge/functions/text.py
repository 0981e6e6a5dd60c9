"""Text functions as columns: tokens, sentences, rules, overlaps, normal forms."""

from __future__ import annotations

import functools
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from recallforge.functions.stem import EXCEPTIONS, stem

# Keyword rules (in order: type, importance, confidence, phrases) and greetings.
RULES = (
    ("semantic", 0.85, 0.82, ("i prefer", "i like", "i dislike", "my name is", "call me")),
    ("semantic", 0.9, 0.78, ("remember that", "important:", "do not", "always")),
    ("procedural", 0.75, 0.72, ("workflow", "when you", "steps:", "procedure", "use the")),
    ("reflection", 0.7, 0.68, ("we learned", "next time", "mistake", "root cause")),
)
GREETINGS = ("hi", "hey", "hello", "ok", "okay", "thanks", "thank you", "bye", "goodbye", "yes", "no", "sure", "cool", "nice", "great", "fine", "alright", "hmm", "lol")


def tokens(text: Column | str) -> Column:
    """Lower-case tokens of letters, digits and apostrophes; a final 's or apostrophe goes; duplicates stay."""
    parts = F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[^\p{L}\p{N}']+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.regexp_replace(F.lower(w), "('s|')$", ""))


_WORDS = re.compile(r"(?:[^\W_]|')+")


@functools.lru_cache(1 << 16)
def term(word: str) -> str:
    """The stem of a word in lower case without a final 's or apostrophe."""
    low = word.lower()
    return stem(low.removesuffix("'s") if low.endswith("'s") else low.removesuffix("'"))


def stemmed(text: str | None) -> list[str]:
    """The stemmed tokens of a text, in order; duplicates stay."""
    return [term(w) for w in _WORDS.findall(text or "")]


class TermNumbers:
    """The numbers of the terms that words are stemmed to, among those of a given vocabulary.

    A stem has the first two letters of its word, but for a few exceptional words, so most words of other beginnings need
    no stemming.
    """

    def __init__(self, vocabulary: dict[str, int], most: int = 150_000):
        self.vocabulary, self.most, self.known = vocabulary, most, {}
        self.begins = {t[:2] for t in vocabulary}

    def number(self, word: str) -> int:
        """-1 for words of other terms."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > self.most:
                self.known.clear()
            low = word.lower()
            low = low.removesuffix("'s") if low.endswith("'s") else low.removesuffix("'")
            bare = low.removeprefix("'")
            near = len(bare) <= 3 or bare[:2] in self.begins or bare[:1] in self.begins or bare in EXCEPTIONS
            found = self.known[word] = self.vocabulary.get(stem(low), -1) if near else -1
        return found

    def sequence(self, text: str | None) -> list[int]:
        """The numbers of all tokens of a text, in order."""
        return [self.number(w) for w in _WORDS.findall(text or "")]

    def count(self, text: str | None) -> tuple[int, dict[int, int]]:
        """How many tokens a text has, and how often each term of the vocabulary."""
        words, out = Counter(_WORDS.findall(text or "")), {}
        for w, n in words.items():
            k = self.number(w)
            if k >= 0:
                out[k] = out.get(k, 0) + n
        return words.total(), out


@F.pandas_udf(ArrayType(StringType()))
def terms(text: pd.Series) -> pd.Series:
    """``stemmed`` over a column; each worker stems a word once."""
    return text.map(stemmed)


def stem_all(tokens: Column | str) -> Column:
    """Stems of an array of tokens."""
    return _stem_all(tokens)


@F.pandas_udf(ArrayType(StringType()))
def _stem_all(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: [term(w) for w in t])


def overlap(a: str | None, b: str | None) -> float:
    """Jaccard overlap of the token sets of two texts; 0 if either has none."""
    x, y = set(stemmed(a)), set(stemmed(b))
    return len(x & y) / len(x | y) if x and y else 0.0


def sentences(text: Column) -> Column:
    """Trimmed non-empty sentences, split at . ! ? and line ends."""
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(cut, lambda s: s != "")


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | F.contains(text, F.lit(n))
    return found


def classify(lower: Column) -> Column:
    """The memory type, importance and confidence of a lower-case sentence: the first rule that has a phrase in it."""
    out = None
    for kind, importance, confidence, phrases in RULES:
        value = F.struct(F.lit(kind).alias("memory_type"), F.lit(importance).alias("importance"), F.lit(confidence).alias("confidence"))
        out = F.when(contains_any(lower, phrases), value) if out is None else out.when(contains_any(lower, phrases), value)
    return out.otherwise(F.struct(F.lit("episodic").alias("memory_type"), F.lit(0.45).alias("importance"), F.lit(0.58).alias("confidence")))


def should_keep(lower: Column, memory_type: Column) -> Column:
    """Drops sentences of under 12 bytes, working memories and bare greetings."""
    words = F.size(F.split(F.trim(lower), r"\s+"))
    chat = (memory_type == "episodic") & (words <= 3) & F.trim(lower).isin(*GREETINGS)
    return (F.octet_length(lower) >= 12) & (memory_type != "working") & ~chat


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def summary(actor: Column, text: Column, most: int = 240) -> Column:
    """``actor said: text`` on one line, cut after ``most`` characters (not bytes, so no character is cut apart)."""
    line = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), "\n", " ")
    return F.concat(actor, F.lit(" said: "), F.when(F.octet_length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line))


def merged(a: str, b: str) -> str:
    """The text that holds the other one, else both."""
    return a if b in a else b if a in b else f"{a}; {b}"


def squeeze(text: Column) -> Column:
    """Lower case with runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def hex_pairs(m: Column) -> Column:
    """A string map as hex key=value pairs in key order."""
    pairs = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(pairs, lambda e: F.concat(F.lower(F.hex(e["key"])), F.lit("="), F.lower(F.hex(e["value"])))), ";")
