"""The published Porter2 (English Snowball) stemmer, applied to distinct words only."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Exceptional forms, invariant forms and suffix tables of the published algorithm.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
INVARIANT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
VOWEL, REST = "[aeiouy]", "[^aeiouy]"
_START = re.compile("^(gener|commun|arsen)")
_REGION = re.compile(f"{VOWEL}{REST}")
_SHORT = re.compile(f"(^{VOWEL}{REST}|{REST}{VOWEL}[^aeiouywxY])$")
_DOUBLE = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


#: Letters that a word ends with before any step; words with other ends stay as they are.
ENDS = frozenset("'sdgylirnmect")


def _after(w: str, start: int) -> int:
    found = _REGION.search(w, start)
    return found.end() if found else len(w)


class Suffixes:
    """A set of suffixes, asked for the longest one of a word."""

    def __init__(self, *suffixes: str):
        self.by_length = [(n, frozenset(s for s in suffixes if len(s) == n)) for n in sorted({len(s) for s in suffixes}, reverse=True)]

    def of(self, w: str) -> str:
        for n, some in self.by_length:
            if w[-n:] in some:
                return w[-n:]
        return ""


_POSSESSIVE, _PLURAL, _PAST = Suffixes("'", "'s", "'s'"), Suffixes("sses", "ied", "ies", "us", "ss", "s"), Suffixes("eedly", "ingly", "edly", "eed", "ing", "ed")
_SECOND, _THIRD, _FOURTH = Suffixes(*STEP2, "ogi", "li"), Suffixes(*STEP3, "ative"), Suffixes(*STEP4, "ion")


def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    w = word.removeprefix("'")
    if len(word) <= 2:
        return word
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    if len(w) <= 2 or w[-1] not in ENDS:
        return w
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    start = _START.match(w)
    r1 = start.end() if start else _after(w, 0)
    r2 = _after(w, r1)
    w = w.removesuffix(_POSSESSIVE.of(w))
    s = _PLURAL.of(w)
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and re.search(VOWEL, w[:-2]):
        w = w[:-1]
    if w in INVARIANT:
        return w
    s = _PAST.of(w)
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and re.search(VOWEL, w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    s = _SECOND.of(w)
    if s and len(w) - len(s) >= r1:
        if s == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif s == "li":
            w = w[:-2] if w[-3:-2] in set("cdeghkmnrt") else w
        else:
            w = w[: -len(s)] + STEP2[s]
    s = _THIRD.of(w)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + STEP3.get(s, "")
    s = _FOURTH.of(w)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def vocabulary(rows: DataFrame, words: Column) -> DataFrame:
    """(word, n, stem): every distinct word of an array column, counted, and stemmed once."""
    counted = rows.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.withColumn("stem", stems("word"))
