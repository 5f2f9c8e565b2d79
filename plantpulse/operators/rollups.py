"""Mergeable rollups of the facts, and the analyses that are answered from them.

A rollup row holds counts, sums, extremes and second moments of the readings of one
(machine, day, hour, mode, status) that one load added.  Rows of any number of loads
merge: counts and sums add up, extremes are taken again, and second moments follow the parallel
variance formula, M2 = sum(M2_i) + sum(n_i * (mean_i - mean)**2).

The analyses here return the same rows and columns as those of the same name in
``analytics`` and ``fleet``, which read the facts; they touch no fact file.  What they read
grows with machines and hours, not with readings.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.functions.columns import (
    MICROS_PER_HOUR, day_type, is_active, is_failure, operating_state, safe_ratio, ts_of_time_key,
)
from plantpulse.operators.ranking import ranking_report
from plantpulse.schema import (
    ABNORMAL_VIBRATION_MEAN, ABNORMAL_VIBRATION_SD, PAIRED_MEASURES, PAIRED_ROLLUP, PRODUCTION_MEASURES, PRODUCTION_ROLLUP,
)

KEYS = ["machine_key", "day", "hour", "operation_mode", "efficiency_status"]


class Rollups(NamedTuple):
    machine_dim: DataFrame
    production: DataFrame
    paired: DataFrame


# -- made by a load ----------------------------------------------------------
#: Rows that one task of a rollup aggregates; a group's sums take about ten times the room of a reading.
ROWS_A_TASK = 250_000


def tasks_for(n_rows: int) -> int:
    """Tasks that a rollup of so many rows is dealt to."""
    return max(1, -(-n_rows // ROWS_A_TASK))


def _hourly(fact: DataFrame, tasks: int):
    """Rows by group.  Where groups hold few readings, a map-side part would only grow them before the shuffle, so the
    readings of more than one task are dealt by group first."""
    ts = ts_of_time_key()
    rows = fact.withColumns({"day": F.to_date(ts), "hour": F.hour(ts)})
    return (rows.repartition(tasks, *KEYS) if tasks > 1 else rows).groupBy(*KEYS)


def production_rollup(fact: DataFrame, tasks: int = 1) -> DataFrame:
    """Rollup rows of new production rows, aggregated in so many tasks."""
    failed, energy = is_failure(), safe_ratio("power_kw", "speed_uph")
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("n_failures"),
            F.min(F.when(failed, F.col("time_key"))).alias("first_failure"),
            F.max(F.when(failed, F.col("time_key"))).alias("last_failure"),
            F.count(energy).alias("energy_n"), F.sum(energy).alias("energy_sum")]
    for m in PRODUCTION_MEASURES:
        aggs += [F.count(m).alias(f"{m}_n"), F.sum(m).alias(f"{m}_sum"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"),
                 (F.var_pop(m) * F.count(m)).alias(f"{m}_m2")]
    return _hourly(fact, tasks).agg(*aggs).select(*PRODUCTION_ROLLUP.fieldNames())


def paired_rollup(wide: DataFrame, tasks: int = 1) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in PAIRED_MEASURES:
        aggs += [F.count(m).alias(f"{m}_n"), F.sum(m).alias(f"{m}_sum"), F.max(m).alias(f"{m}_max")]
    return _hourly(wide, tasks).agg(*aggs).select(*PAIRED_ROLLUP.fieldNames())


# -- merging -----------------------------------------------------------------
def mean(m: str) -> Column:
    """Mean of a measure over the merged rows; NULL without a value."""
    return safe_ratio(F.sum(f"{m}_sum"), F.sum(f"{m}_n"))


def count() -> Column:
    return F.sum("n").alias("n_readings")


def with_deviations(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """``rows`` with ``<m>_dev``: what a row adds to M2 of its group ``by``, about the group's mean.

    The window holds rollup rows of one group and is partitioned like the aggregate that follows it (one shuffle).
    """
    w = Window.partitionBy(*by)
    out = rows
    for m in measures:
        group = safe_ratio(F.sum(f"{m}_sum").over(w), F.sum(f"{m}_n").over(w))
        own = safe_ratio(f"{m}_sum", f"{m}_n")
        out = out.withColumn(f"{m}_dev", F.col(f"{m}_m2") + F.col(f"{m}_n") * (own - group) * (own - group))
    return out


def deviation(m: str) -> Column:
    """Sample standard deviation over merged rows that have ``<m>_dev``; NULL below two values."""
    n = F.sum(f"{m}_n")
    return F.when(n > 1, F.sqrt(F.sum(f"{m}_dev") / (n - 1)))


def _with_id(df: DataFrame, r: Rollups) -> DataFrame:
    return df.join(r.machine_dim.select("machine_key", "machine_id"), "machine_key").drop("machine_key")


# -- analyses ----------------------------------------------------------------
def machine_efficiency(r: Rollups) -> DataFrame:
    agg = r.production.groupBy("machine_key", "efficiency_status").agg(
        mean("speed_uph").alias("avg_speed"), mean("error_rate_pct").alias("avg_error_rate"), count())
    return _with_id(agg, r).select("machine_id", "efficiency_status", "avg_speed", "avg_error_rate", "n_readings") \
        .orderBy(F.desc("avg_speed"), "machine_id", "efficiency_status")


def oee_two_factor(r: Rollups) -> DataFrame:
    agg = r.paired.groupBy("machine_key").agg(
        safe_ratio(mean("speed_uph"), F.max("speed_uph_max")).alias("speed_ratio"),
        (F.lit(1.0) - mean("defect_rate_pct") / 100.0).alias("quality"))
    return _with_id(agg, r).select("machine_id", "speed_ratio", "quality", (F.col("speed_ratio") * F.col("quality")).alias("oee")) \
        .orderBy(F.desc("oee"), "machine_id")


def hourly_performance(r: Rollups) -> DataFrame:
    return r.production.groupBy("hour").agg(
        mean("speed_uph").alias("avg_speed"), mean("error_rate_pct").alias("avg_error_rate"), count()).orderBy("hour")


def active_vs_idle(r: Rollups) -> DataFrame:
    return r.production.groupBy(operating_state().alias("operating_state")).agg(
        count(), mean("temperature_c").alias("avg_temperature"), mean("vibration_hz").alias("avg_vibration"),
        mean("power_kw").alias("avg_power"))


def energy_by_mode(r: Rollups) -> DataFrame:
    return r.production.groupBy("operation_mode").agg(
        mean("power_kw").alias("avg_power"), F.min("power_kw_min").alias("min_power"), F.max("power_kw_max").alias("max_power"),
        count()).orderBy(F.desc("avg_power"), "operation_mode")


def abnormal_vibration(r: Rollups) -> DataFrame:
    rows = with_deviations(r.production.where(is_active()), ["machine_key"], ["vibration_hz"])
    agg = rows.groupBy("machine_key").agg(
        mean("vibration_hz").alias("avg_vibration"), deviation("vibration_hz").alias("sd_vibration"),
        F.max("vibration_hz_max").alias("max_vibration"), count())
    hit = agg.where((F.col("avg_vibration") > ABNORMAL_VIBRATION_MEAN) | (F.col("sd_vibration") > ABNORMAL_VIBRATION_SD))
    return _with_id(hit, r).select("machine_id", "avg_vibration", F.round("sd_vibration", 6).alias("sd_vibration"),
                                   "max_vibration", "n_readings").orderBy(F.desc("avg_vibration"), "machine_id")


def oee_three_factor(r: Rollups) -> DataFrame:
    agg = r.paired.groupBy("machine_key").agg(
        (F.sum(F.when(is_active(), F.col("n")).otherwise(0)) / F.sum("n")).alias("availability"),
        safe_ratio(mean("speed_uph"), F.max("speed_uph_max")).alias("performance"),
        (F.lit(1.0) - mean("defect_rate_pct") / 100.0).alias("quality"), count())
    oee = F.col("availability") * F.col("performance") * F.col("quality")
    return _with_id(agg.withColumn("oee", oee), r).select("machine_id", "availability", "performance", "quality", "oee", "n_readings") \
        .orderBy(F.desc("oee"), "machine_id")


def daily_trend(r: Rollups) -> DataFrame:
    return r.paired.groupBy(F.col("day").alias("reading_date")).agg(
        mean("speed_uph").alias("avg_speed"), mean("error_rate_pct").alias("avg_error_rate"),
        mean("defect_rate_pct").alias("avg_defect_rate"), count()).orderBy("reading_date")


def weekday_vs_weekend(r: Rollups) -> DataFrame:
    return r.production.groupBy(day_type("day").alias("day_type")).agg(
        mean("speed_uph").alias("avg_speed"), mean("error_rate_pct").alias("avg_error_rate"), mean("power_kw").alias("avg_power"), count())


_SD = {"speed_uph": "sd_speed", "temperature_c": "sd_temperature", "vibration_hz": "sd_vibration"}


def deviant_machines(r: Rollups) -> DataFrame:
    rows = with_deviations(r.production.where(is_active()), ["machine_key"], list(_SD))
    sd = _with_id(rows.groupBy("machine_key").agg(*[deviation(m).alias(n) for m, n in _SD.items()]), r)
    means = sd.agg(*[F.avg(n).alias(f"mean_{n}") for n in _SD.values()])  # one row
    above = [F.col(n) > F.col(f"mean_{n}") for n in _SD.values()]
    hit = sd.crossJoin(F.broadcast(means)).where(above[0] | above[1] | above[2])
    return hit.select("machine_id", *[F.round(c, 6).alias(c) for n in (list(_SD.values()), [f"mean_{n}" for n in _SD.values()]) for c in n]) \
        .orderBy(F.desc("sd_speed"), "machine_id")


def productivity_ranking(r: Rollups) -> DataFrame:
    per = r.production.where(is_active()).groupBy("machine_key").agg(
        mean("speed_uph").alias("avg_speed"), mean("error_rate_pct").alias("avg_error_rate"), mean("energy").alias("avg_power_per_unit"))
    return ranking_report(_with_id(per, r))


def last_days(r: Rollups) -> DataFrame:
    """Per machine, the newest day that holds a reading."""
    return r.production.groupBy("machine_key").agg(F.max("day").alias("day"))


# -- fleet KPIs --------------------------------------------------------------
def fleet_oee(r: Rollups) -> DataFrame:
    return oee_three_factor(r).agg(F.round(F.avg("oee"), 9).alias("fleet_oee"), F.count(F.lit(1)).alias("n_machines"))


def failure_rate(r: Rollups) -> DataFrame:
    return r.production.agg((F.sum("n_failures") / F.sum("n")).alias("failure_rate"),
                            F.coalesce(F.sum("n_failures"), F.lit(0)).alias("n_failures"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_readings"))


def _failure_spans(r: Rollups) -> DataFrame:
    return r.production.where("n_failures > 0").groupBy("machine_key").agg(
        F.min("first_failure").alias("_t0"), F.max("last_failure").alias("_t1"), F.sum("n_failures").alias("n_failures"))


def mtbf_by_machine(r: Rollups) -> DataFrame:
    gaps = F.col("n_failures") - 1
    out = _failure_spans(r).select("machine_key", "n_failures", F.when(
        gaps > 0, (F.col("_t1") - F.col("_t0")) / (F.lit(float(MICROS_PER_HOUR)) * gaps)).alias("mtbf_hours"))
    return _with_id(out, r).select("machine_id", "n_failures", "mtbf_hours").orderBy("machine_id")


def mtbf(r: Rollups) -> DataFrame:
    gaps = F.sum(F.col("n_failures") - 1)
    return _failure_spans(r).agg(safe_ratio(F.sum(F.col("_t1") - F.col("_t0")), gaps * F.lit(float(MICROS_PER_HOUR))).alias("mtbf_hours"),
                                 gaps.alias("n_gaps"))


#: The analyses and KPIs answered from rollups, by the name under which they are registered.
ROLLED_UP = {f.__name__: f for f in (
    machine_efficiency, oee_two_factor, hourly_performance, active_vs_idle, energy_by_mode, abnormal_vibration, oee_three_factor,
    daily_trend, weekday_vs_weekend, productivity_ranking, deviant_machines, fleet_oee, failure_rate, mtbf, mtbf_by_machine)}
