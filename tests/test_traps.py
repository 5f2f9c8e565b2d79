"""Remaining semantic traps: duplicate choice (T8), histogram edges (T10),
end-day inclusion (T11), missing-value percent text (T5)."""

from __future__ import annotations

import datetime as dt

from plantpulse.operators.charts import filter_readings, score_histogram
from plantpulse.operators.clean import as_converted
from plantpulse.operators.star import build_star, empty_star
from plantpulse.schema import READINGS


def _readings(spark, rows):
    return spark.createDataFrame(
        [(i, m, ts, "Active", "Low", t, 1.0, 1.0, 100.0, 1.0, 1.0, 1.0, 1.0, pm)
         for i, m, ts, t, pm in rows], READINGS)


def test_duplicate_keeps_smallest_reading_id(spark):
    ts = dt.datetime(2024, 1, 1, 12)
    df = _readings(spark, [(9, 1, ts, 70.0, 0.1), (3, 1, ts, 55.0, 0.1), (5, 1, ts, 60.0, 0.1)])
    star = build_star(as_converted(df), empty_star(spark))
    rows = star.production.collect()
    assert len(rows) == 1 and rows[0]["temperature_c"] == 55.0


def test_histogram_edges(spark):
    ts = dt.datetime(2024, 1, 1)
    df = _readings(spark, [(i, 1, ts + dt.timedelta(minutes=i), 50.0, v)
                           for i, v in enumerate([0.0, 0.5, 1.0, 1.0, 0.25])])
    bins = {r["bin"]: r["n"] for r in score_histogram(df, bins=4).collect()}
    assert bins == {0: 1, 1: 1, 2: 1, 3: 2}            # the maximum closes the last bin
    const = _readings(spark, [(1, 1, ts, 50.0, 0.7), (2, 1, ts + dt.timedelta(minutes=1), 50.0, 0.7)])
    one = score_histogram(const).collect()
    assert [(r["bin"], r["n"], r["bin_start"], r["bin_end"]) for r in one] == [(0, 2, 0.7, 0.7)]


def test_end_day_inclusive_by_default(spark):
    df = _readings(spark, [(1, 1, dt.datetime(2024, 1, 5, 0, 0), 50.0, 0.1),
                           (2, 1, dt.datetime(2024, 1, 5, 18, 0), 50.0, 0.1),
                           (3, 1, dt.datetime(2024, 1, 6, 0, 0), 50.0, 0.1)])
    assert filter_readings(df, start="2024-01-01", end="2024-01-05").count() == 2
    # end_inclusive=False compares to midnight of the end day, as a date-string comparison does
    assert filter_readings(df, start="2024-01-01", end="2024-01-05", end_inclusive=False).count() == 1
    assert filter_readings(df, hours=(12, 23)).count() == 1


def test_percent_text_keeps_missing_missing(spark):
    from plantpulse.functions.display import fmt_pct, fmt_py_pct

    df = spark.createDataFrame([(None,), (0.5,)], "x double")
    got = [tuple(r) for r in df.select(fmt_pct("x"), fmt_py_pct("x", scale=100.0)).collect()]
    assert got == [(None, None), ("0.50%", "50.00%")]
