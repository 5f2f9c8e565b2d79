"""Presentation layer: numbers to text, kept apart from the numeric queries.

Two rounding conventions exist in the analyses and both are reproduced:

* ``py2``    : 2 decimals with thousands separators, rounding the exact binary
               value half-to-even (what a Python format string does);
* ``n2``     : 2 decimals with separators, rounding the *decimal reading* of the
               number half away from zero (what a SQL number format does);
* ``plain2`` : as ``n2`` without separators;
* ``pct``    : ``n2`` followed by a percent sign (NULL stays NULL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.columns import col_

__all__ = ["fmt_py2", "fmt_n2", "fmt_plain2", "fmt_pct", "fmt_plain_pct", "fmt_py_pct", "display"]


def fmt_py2(c: str | Column) -> Column:
    return F.format_number(col_(c), 2)


def fmt_n2(c: str | Column) -> Column:
    return F.format_number(F.round(col_(c), 2), 2)


def fmt_plain2(c: str | Column) -> Column:
    return F.call_function("format_number", F.round(col_(c), 2), F.lit("0.00"))


def _suffix(text: Column, src: Column) -> Column:
    return F.when(src.isNotNull(), F.concat(text, F.lit("%")))


def fmt_pct(c: str | Column) -> Column:
    c = col_(c)
    return _suffix(fmt_n2(c), c)


def fmt_py_pct(c: str | Column, scale: float = 1.0) -> Column:
    """Python-style percent text; ``scale=100`` turns a fraction into percent."""
    c = col_(c) * F.lit(scale) if scale != 1.0 else col_(c)
    return _suffix(fmt_py2(c), c)


def fmt_plain_pct(c: str | Column) -> Column:
    c = col_(c)
    return _suffix(fmt_plain2(c), c)


_STYLES = {"py2": fmt_py2, "n2": fmt_n2, "plain2": fmt_plain2, "pct": fmt_pct,
           "plain_pct": fmt_plain_pct, "py_pct": fmt_py_pct,
           "py_pct100": lambda c: fmt_py_pct(c, scale=100.0)}


def display(df: DataFrame, styles: dict[str, str]) -> DataFrame:
    """Replace each named numeric column by its text form; other columns pass."""
    return df.withColumns({c: _STYLES[s](c) for c, s in styles.items()})
