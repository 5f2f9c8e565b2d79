"""Fleet KPIs: overall OEE, failure rate, mean time between failures, trend.

Definitions (the KPIs are stated without a formula, so these are choices):

* fleet OEE: mean over machines of the three-factor OEE;
* failure rate: share of readings whose error rate is above the failure
  threshold;
* MTBF: mean gap in hours between successive failing readings of a machine.
  The gaps of one machine telescope -- their sum is last minus first failure
  -- so per machine it is ``(max - min) / (n - 1)`` and fleet-wide
  ``sum(max - min) / sum(n - 1)``: a partial aggregation, no sort, no window;
* trend: each KPI over the last ``hours`` vs the ``hours`` before, anchored at
  the newest reading; within +-5 % relative change counts as stable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.columns import MICROS_PER_HOUR, is_active, is_failure, safe_ratio
from plantpulse.operators.analytics import oee_three_factor, with_machine_id
from plantpulse.operators.star import Star

STABLE_BAND = 0.05  # relative change treated as "stable"


def recent_star(wh, hours: int = 2) -> Star:
    """The warehouse star pruned to the partitions that can hold the last
    ``2 * hours`` of readings: the newest reading lies in the newest date
    partition, so nothing older than that day minus the window is needed."""
    import datetime as dt
    import math

    last = wh.latest_date()
    if last is None:
        return wh.star()
    back = dt.timedelta(days=math.ceil(2 * hours / 24) + 1)
    return wh.star_since(last - back)


def fleet_oee(star: Star) -> DataFrame:
    per = oee_three_factor(star)
    return per.agg(F.round(F.avg("oee"), 9).alias("fleet_oee"), F.count(F.lit(1)).alias("n_machines"))


def failure_rate(star: Star) -> DataFrame:
    f = is_failure()
    return star.production.agg(
        F.avg(F.when(f, 1.0).otherwise(0.0)).alias("failure_rate"),
        F.count_if(f).alias("n_failures"), F.count(F.lit(1)).alias("n_readings"))


def _failure_spans(star: Star) -> DataFrame:
    return (star.production.where(is_failure()).groupBy("machine_key")
            .agg(F.min("time_key").alias("_t0"), F.max("time_key").alias("_t1"),
                 F.count(F.lit(1)).alias("n_failures")))


def mtbf_by_machine(star: Star) -> DataFrame:
    s = _failure_spans(star)
    # one division of two exact integers: the same double in any engine
    out = s.select("machine_key", "n_failures", F.when(
        F.col("n_failures") > 1,
        (F.col("_t1") - F.col("_t0")) / (F.lit(float(MICROS_PER_HOUR)) * (F.col("n_failures") - 1))
    ).alias("mtbf_hours"))
    return with_machine_id(out, star).select("machine_id", "n_failures", "mtbf_hours").orderBy("machine_id")


def mtbf(star: Star) -> DataFrame:
    s = _failure_spans(star)
    span = F.sum(F.col("_t1") - F.col("_t0"))
    gaps = F.sum(F.col("n_failures") - 1)
    return s.agg(safe_ratio(span, gaps * F.lit(float(MICROS_PER_HOUR))).alias("mtbf_hours"),
                 gaps.alias("n_gaps"))


def kpi_trend(source, hours: int = 2) -> DataFrame:
    """KPIs for the last ``hours`` vs the ``hours`` before (one row per KPI).

    ``source`` is a warehouse, whose partitions are pruned for the same
    ``hours`` (:func:`recent_star`), or a star, read whole.  The newest time key is
    looked up first (one number), so that the window is a literal that reaches
    the scans of both facts."""
    star = source if isinstance(source, Star) else recent_star(source, hours)
    win = hours * MICROS_PER_HOUR
    last = star.production.agg(F.max("time_key")).first()[0] or 0
    tk = F.col("time_key")
    tag = F.when(tk > last - win, "recent").otherwise("previous")
    j = (star.production.where(tk > last - 2 * win)
         .join(star.quality.where(tk > last - 2 * win), ["machine_key", "time_key"])
         .withColumn("_tag", tag))
    f = is_failure()
    per = (j.groupBy("_tag", "machine_key").agg(
        F.avg(F.when(is_active(), 1.0).otherwise(0.0)).alias("_a"),
        safe_ratio(F.avg("speed_uph"), F.max("speed_uph")).alias("_p"),
        (F.lit(1.0) - F.avg("defect_rate_pct") / 100.0).alias("_q"),
        F.count(F.lit(1)).alias("_n"), F.count_if(f).alias("_nf"),
        F.min(F.when(f, tk)).alias("_t0"), F.max(F.when(f, tk)).alias("_t1")))
    per_tag = per.groupBy("_tag").agg(
        F.avg(F.col("_a") * F.col("_p") * F.col("_q")).alias("oee"),
        (F.sum("_nf") / F.sum("_n")).alias("failure_rate"),
        (safe_ratio(F.sum(F.col("_t1") - F.col("_t0")),
                    F.sum(F.when(F.col("_nf") > 0, F.col("_nf") - 1)))
         / F.lit(float(MICROS_PER_HOUR))).alias("mtbf_hours"))
    long = per_tag.unpivot(["_tag"], ["oee", "failure_rate", "mtbf_hours"], "kpi", "value")
    wide = (long.groupBy("kpi").agg(
        F.round(F.max(F.when(F.col("_tag") == "recent", F.col("value"))), 9).alias("recent"),
        F.round(F.max(F.when(F.col("_tag") == "previous", F.col("value"))), 9).alias("previous")))
    change = F.round(safe_ratio(F.col("recent") - F.col("previous"), F.col("previous")), 9)
    return (wide.withColumn("relative_change", change)
            .withColumn("trend", F.when(F.col("relative_change").isNull(), "unknown")
                        .when(F.abs(F.col("relative_change")) <= STABLE_BAND, "stable")
                        .when(F.col("relative_change") > 0, "rising").otherwise("falling"))
            .orderBy("kpi"))
