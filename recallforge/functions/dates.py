"""Dates in prose: calendar dates, weekdays before or after a date, weeks; comparisons with some tolerance."""

from __future__ import annotations

import calendar
import functools
import re
from collections.abc import Callable
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Short names of months and weekdays besides their first three letters, years that are dates, and days of tolerance.
MONTHS = {n.lower(): i for names in (calendar.month_name, calendar.month_abbr) for i, n in enumerate(names) if n} | {"sept": 9}
WEEKDAYS = {n.lower(): i for names in (calendar.day_name, calendar.day_abbr) for i, n in enumerate(names)} | {"tues": 1, "weds": 2, "thur": 3, "thurs": 3}
YEARS, TOLERANCE = range(1900, 2101), 2
Week = tuple[date, date]


def number(token: str | None) -> int | None:
    return int(token) if token and re.fullmatch(r"[0-9]{1,9}", token) else None


def day_of(year: int, month: int, day: int) -> date:
    """A day counted from the first of its month, so a 31 February is a day in March."""
    return date(year, month, 1) + timedelta(day - 1)


def calendar_date(tokens: list[str]) -> date | None:
    """The first month that is named, with the day beside it (left, else right), in the first year of the text."""
    at = next((i for i, t in enumerate(tokens) if t in MONTHS), None)
    if at is None:
        return None
    sides = [number(tokens[i]) for i in (at - 1, at + 1) if 0 <= i < len(tokens)]
    day = next((d for d in sides if d is not None and 1 <= d <= 31), None)
    year = next((n for n in map(number, tokens) if n in YEARS), None)
    return day_of(year, MONTHS[tokens[at]], day) if day and year else None


def relative_date(tokens: list[str]) -> date | None:
    """``<weekday> before|after <date>``; the same weekday is the date itself."""
    at = next((i for i, t in enumerate(tokens) if t in ("before", "after")), 0)
    if not at or tokens[at - 1] not in WEEKDAYS or (anchor := calendar_date(tokens[at + 1 :])) is None:
        return None
    ahead = (WEEKDAYS[tokens[at - 1]] - anchor.weekday()) % 7
    return anchor + timedelta(ahead if tokens[at] == "after" else -((7 - ahead) % 7))


def week(tokens: list[str]) -> Week | None:
    """Monday to Sunday of ``week of|before|after <date>``."""
    if "week" not in tokens:
        return None
    rest = tokens[tokens.index("week") + 1 :]
    shift = {"before": -7, "after": 7, "of": 0}.get(rest[0] if rest else "")
    anchor = calendar_date(rest if shift is None else rest[1:])
    if anchor is None:
        return None
    day = anchor + timedelta(shift or 0)
    monday = day - timedelta(day.weekday())
    return monday, monday + timedelta(6)


@functools.lru_cache(1 << 15)
def meant(text: str) -> tuple[tuple[date, ...], Week | None]:
    """The days and the week that a normal form means; texts repeat, so they are remembered, in bounded memory."""
    tokens = text.split()
    return tuple(d for d in (calendar_date(tokens), relative_date(tokens)) if d), week(tokens)


def same_date(a: str, b: str) -> bool:
    """Whether two normal forms mean about the same: days within the tolerance, a day in a week, weeks that overlap."""
    (days, own), (others, theirs) = meant(a), meant(b)
    close = any(abs((d - e).days) <= TOLERANCE for d in days for e in others)
    inside = any(w is not None and w[0] <= d <= w[1] for w, ds in ((theirs, days), (own, others)) for d in ds)
    both = own is not None and theirs is not None and own[0] <= theirs[1] and theirs[0] <= own[1]
    return close or inside or both


def _fits(a: str, g: str) -> bool:
    return g != "" and (g in a or a in g)


def fits_or_same_date(empty_is_right: bool) -> Callable[[Column, Column], Column]:
    """Of normal forms of an answer and of gold answers: whether either holds the other, or both mean about the same date.

    Null, as SQL has it, without gold answers; an empty answer is wrong unless ``empty_is_right``.
    """

    def judged(answer: pd.Series, gold: pd.Series) -> pd.Series:
        out = []
        for a, golds in zip(answer, gold, strict=True):
            a, may = a or "", bool(a) or empty_is_right
            if golds is None:
                out.append(None if may else False)
            else:
                out.append(any((may and _fits(a, g)) or (g and same_date(a, g)) for g in golds))
        return pd.Series(out, dtype=object)

    judged.__annotations__ = {"answer": pd.Series, "gold": pd.Series, "return": pd.Series}
    return F.pandas_udf(judged, BooleanType())


def shown(d: date) -> str:
    """As 7 May 2023."""
    return f"{d.day} {calendar.month_name[d.month]} {d.year}"


def shifted(day: Column, days: int) -> Column:
    return F.date_add(day, days)


def shown_column(day: Column) -> Column:
    return F.date_format(day, "d MMMM yyyy")


def week_of(day: Column) -> Column:
    """(monday, sunday) of a day's week."""
    monday = F.to_date(F.date_trunc("week", day))
    return F.struct(monday.alias("monday"), F.date_add(monday, 6).alias("sunday"))
