"""Dashboard data: the frames behind each chart, as DataFrames.

Drawing is out of scope; each function returns what a chart would plot.
Inputs are flat readings (schema ``READINGS``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.operators.analytics import readings_view
from plantpulse.schema import HISTOGRAM_BINS


def _ts_lit(day: str | dt.date) -> F.Column:
    return F.lit(str(day)).cast("timestamp_ntz")


def filter_readings(readings: DataFrame, start: str | None = None, end: str | None = None,
                    hours: tuple[int, int] = (0, 23), machine="all", mode="all",
                    end_inclusive: bool = True) -> DataFrame:
    """Dashboard filters.  Dates are days (YYYY-MM-DD); both ends inclusive by
    default (``end_inclusive=False`` keeps only midnight of the end day, as a
    timestamp-to-date comparison does).  Hours are an inclusive range.
    ``'all'`` disables the machine / mode filter.  Date, machine and mode
    predicates are literal comparisons, so they reach the Parquet scan."""
    ts = F.col("reading_ts")
    df = readings
    if start is not None:
        df = df.where(ts >= _ts_lit(start))
    if end is not None:
        if end_inclusive:
            nxt = dt.date.fromisoformat(str(end)[:10]) + dt.timedelta(days=1)
            df = df.where(ts < _ts_lit(nxt))
        else:
            df = df.where(ts <= _ts_lit(end))
    lo, hi = hours
    if (lo, hi) != (0, 23):
        df = df.where(F.hour(ts).between(lo, hi))
    if machine != "all":
        df = df.where(F.col("machine_id") == F.lit(int(machine)))
    if mode != "all":
        df = df.where(F.col("operation_mode") == F.lit(mode))
    return df


def filter_warehouse(wh, start: str | None = None, end: str | None = None, hours: tuple[int, int] = (0, 23), machine="all",
                     mode="all", end_inclusive: bool = True) -> DataFrame:
    """:func:`filter_readings` over the readings of a warehouse.  The dates prune partitions; the machine becomes a
    literal key on the facts, which lie in machine order, so row groups of other machines are skipped."""
    whole = start is None and end is None
    star = wh.star() if whole else wh.star_between(dt.date.fromisoformat(str(start or dt.date.min)[:10]),
                                                   None if end is None else dt.date.fromisoformat(str(end)[:10]))
    if machine != "all":
        key = wh.machine_key(int(machine))
        own = F.lit(False) if key is None else F.col("machine_key") == F.lit(key)
        star = star._replace(production=star.production.where(own), quality=star.quality.where(own), wide=star.wide.where(own))
    return filter_readings(readings_view(star), start, end, hours, "all", mode, end_inclusive)


def data_status(df: DataFrame) -> DataFrame:
    """One row: how many rows the filters keep, and 'no data' when none."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "status", F.when(F.col("n_rows") > 0, "ok").otherwise("no data"))


def _series(df: DataFrame, col: str, every: str | None) -> DataFrame:
    if every is None:
        return df.select("machine_id", "reading_ts", col).orderBy("machine_id", "reading_ts")
    # Down-sampling keeps a chart's size bounded by machines x time buckets.
    return (df.groupBy("machine_id", F.window("reading_ts", every).start.alias("bucket_start"))
            .agg(F.avg(col).alias(col), F.count(F.lit(1)).alias("n_readings"))
            .orderBy("machine_id", "bucket_start"))


def production_series(df: DataFrame, every: str | None = None) -> DataFrame:
    return _series(df, "speed_uph", every)


def error_series(df: DataFrame, every: str | None = None) -> DataFrame:
    return _series(df, "error_rate_pct", every)


def mode_codes(readings: DataFrame) -> DataFrame:
    """Alphabetical integer code per operation mode (0, 1, ...): the ranking
    runs over the handful of distinct modes, not over readings."""
    modes = readings.select("operation_mode").distinct()
    return modes.withColumn("mode_code", (F.dense_rank().over(Window.orderBy("operation_mode")) - 1))


def means_by_mode(df: DataFrame) -> DataFrame:
    """Mean speed and error per operation mode.  Grouping by the label itself
    makes the encode / decode round trip of the dashboard unnecessary (the
    codes, where wanted, are :func:`mode_codes`)."""
    return (df.groupBy("operation_mode")
            .agg(F.avg("speed_uph").alias("avg_speed"), F.avg("error_rate_pct").alias("avg_error_rate"))
            .orderBy("operation_mode"))


def means_by_machine(df: DataFrame) -> DataFrame:
    return (df.groupBy("machine_id")
            .agg(F.avg("speed_uph").alias("avg_speed"), F.avg("error_rate_pct").alias("avg_error_rate"))
            .orderBy("machine_id"))


def score_histogram(df: DataFrame, col: str = "pm_score", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over [min, max]; the maximum goes in the last bin; a
    constant column is one bin.

    One scan: the readings are counted per score; the bounds (one row, broadcast)
    and the bins are both taken from these counts, and the planner reuses their shuffle."""
    scores = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("score")).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    bounds = scores.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = (F.when(F.col("_hi") == F.col("_lo"), F.lit(0))
         .otherwise(F.least(F.floor((F.col("score") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int"))
    return (scores.crossJoin(F.broadcast(bounds))
            .groupBy(b.alias("bin"), "_lo", "_hi")
            .agg(F.sum("n").alias("n"))
            .select("bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
                    F.when(F.col("_hi") == F.col("_lo"), F.col("_hi"))
                    .otherwise(F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"), "n")
            .orderBy("bin"))


def filter_domains(readings: DataFrame) -> DataFrame:
    """Choices for the filters as (kind, code, label) rows: first / last day,
    each machine id, each operation mode with its code.

    One scan and one shuffle: an aggregate by grouping sets (machine), (mode) and ().  Modes are
    numbered by a window over their own rows; machines are spread over its partitions by their id.
    Without readings there is nothing to choose from: no rows."""
    sets = readings.groupingSets([[F.col("machine_id")], [F.col("operation_mode")], []], F.col("machine_id"), F.col("operation_mode")).agg(
        F.grouping_id().alias("_set"), F.min("reading_ts").alias("_t0"), F.max("reading_ts").alias("_t1"))
    machine, mode = F.col("_set") == 1, F.col("_set") == 2  # bits: which of (machine, mode) a row is not grouped by
    number = F.dense_rank().over(Window.partitionBy("_set", "machine_id").orderBy("operation_mode")) - 1
    day = lambda code, ts: F.struct(F.lit("date").alias("kind"), F.lit(code).alias("code"), F.to_date(ts).cast("string").alias("label"))
    rows = F.when(machine, F.array(F.struct(F.lit("machine").alias("kind"), F.col("machine_id").alias("code"),
                                            F.col("machine_id").cast("string").alias("label")))) \
        .when(mode, F.array(F.struct(F.lit("mode").alias("kind"), F.col("_no").alias("code"), F.col("operation_mode").alias("label")))) \
        .otherwise(F.array(day(0, "_t0"), day(1, "_t1")))
    return sets.withColumn("_no", number).select(F.inline(rows)).orderBy("kind", "code")


def means_long(wide: DataFrame, ids: list[str], measures: list[str] | None = None) -> DataFrame:
    """Wide means -> (ids..., measure, value) rows for grouped bars."""
    measures = measures or [c for c in wide.columns if c not in ids]
    return wide.unpivot(ids, measures, "measure", "value")
