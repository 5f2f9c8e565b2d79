"""Timestamp texts: a fixed list of layouts, a vote per file, and parsing with the chosen one.

A file has one layout.  A bounded sample of its texts is tried with every
layout and the one that reads most of them wins; of equals, the one listed
first.  So ``01/02/2024`` is read month first, unless the sample also holds a text that only
the day-first layout can read.  All rows of the file are then read with
that layout; a text that does not fit is no timestamp (its row is rejected), even if
another layout could read it.

Parsing is by built-in expressions: a layout turns the text into the standard one, which
``try_cast`` then checks (month 13 or hour 25 give NULL).  No session time zone is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_D, _Y = r"(\d{1,2})", r"(\d{4})"

#: Name -> (pattern of the date part, its standard form), in the order that decides ties.
LAYOUTS: dict[str, tuple[str, str]] = {
    "year-month-day": (rf"^{_Y}-{_D}-{_D}", "$1-$2-$3"),
    "month/day/year": (rf"^{_D}/{_D}/{_Y}", "$3-$1-$2"),
    "day/month/year": (rf"^{_D}/{_D}/{_Y}", "$3-$2-$1"),
    "year/month/day": (rf"^{_Y}/{_D}/{_D}", "$1-$2-$3"),
    "month-day-year": (rf"^{_D}-{_D}-{_Y}", "$3-$1-$2"),
    "day-month-year": (rf"^{_D}-{_D}-{_Y}", "$3-$2-$1"),
    "day.month.year": (rf"^{_D}\.{_D}\.{_Y}", "$3-$2-$1"),
    "yearmonthday": (r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3"),
}
STANDARD = "year-month-day"
#: Date and time are apart by spaces or a T; hours, minutes, seconds and fractions follow.
_TIME = r"(?:(?: +|T)\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,9})?)?)?"
_HALF = r" *([AaPp])[Mm]$"
_ZONE = r"(?:Z|[+-]\d{2}:?\d{2})?$"


def _fit(text: Column, pattern: Column, standard: Column) -> Column:
    text = F.trim(text)
    half = F.upper(F.regexp_extract(text, _HALF, 1))
    plain = F.regexp_replace(text, _HALF, "")
    fits = F.regexp_like(plain, F.concat(pattern, F.lit(_TIME + _ZONE)))
    body = F.regexp_replace(F.regexp_replace(plain, _ZONE, ""), pattern, standard)
    at = F.when(fits, F.regexp_replace(body, r"(\d)(?:T| +)(\d)", "$1 $2").try_cast("timestamp_ntz"))
    parts = F.transform(F.array(F.struct(at.alias("at"), half.alias("half"))), _half_day)  # evaluated once per row
    return parts[0]


def _half_day(x: Column) -> Column:
    at, half = x["at"], x["half"]
    hour = F.hour(at)
    shift = F.when((half == "P") & (hour < 12), 12).when((half == "A") & (hour == 12), -12).otherwise(0)
    return F.when(half == "", at).when(hour.between(1, 12), F.timestamp_add("HOUR", shift, at))


def parse_as(text: Column, layout: str) -> Column:
    """The timestamp (no time zone) that ``text`` gives in a layout, else NULL.  A zone at the end is dropped;
    AM and PM are taken into account."""
    pattern, standard = LAYOUTS[layout]
    return _fit(text, F.lit(pattern), F.lit(standard))


def parse_by(text: Column, layout: Column) -> Column:
    """As :func:`parse_as`, the layout's name taken from a column.  Without a name (or with an unknown one) the
    standard layout counts, by a plain ``try_cast``."""
    others = [n for n in LAYOUTS if n != STANDARD]
    look_up = lambda i: F.element_at(F.create_map(*[F.lit(x) for n in others for x in (n, LAYOUTS[n][i])]), layout)
    return F.when(layout.isin(others), _fit(text, look_up(0), look_up(1))).otherwise(text.try_cast("timestamp_ntz"))


def vote(samples: DataFrame, group: str = "file", text: str = "text") -> DataFrame:
    """``group, layout`` with the layout that reads most of a group's texts; a group of which no
    layout reads any text gets the standard one."""
    names = list(LAYOUTS)
    read = samples.groupBy(group).agg(*[F.count(parse_as(F.col(text), n)).alias(f"n{i}") for i, n in enumerate(names)])
    best = F.greatest(*[F.col(f"n{i}") for i in range(len(names))])
    chosen = F.coalesce(*[F.when(F.col(f"n{i}") == best, F.lit(n)) for i, n in enumerate(names)])
    return read.select(group, chosen.alias("layout"))
