"""The eighteen analyses over the star, as lazy DataFrame functions.

Plan rules applied throughout:

* aggregate on ``machine_key`` first, join the machine dimension afterwards
  (one row per machine instead of one per reading goes through the join);
* the time dimension is never joined: ``time_key`` *is* the timestamp in
  microseconds, so hour / date / weekday are per-row expressions;
* no window partitioned by machine over raw readings: a machine may hold a
  third of all rows.  "Latest reading" and "previous failure" are rewritten as
  partial aggregations (map-side combine), which cannot skew;
* filters are plain column predicates, so they reach the Parquet scan;
* numbers stay numbers; text formatting lives in ``functions.display``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.functions.columns import (
    MICROS_PER_HOUR, day_type, is_active, is_failure, operating_state, safe_ratio,
    temperature_band, temperature_band_no, ts_of_time_key,
)
from plantpulse.functions.display import fmt_pct
from plantpulse.operators.ranking import ranking_report
from plantpulse.operators.rollups import last_days
from plantpulse.operators.star import Star
from plantpulse.schema import (
    ABNORMAL_VIBRATION_MEAN, ABNORMAL_VIBRATION_SD, HIGH_TEMPERATURE_C, HIGH_VIBRATION_HZ, MEASURES, TOP_N,
)

KEYS = ["machine_key", "time_key"]


def _cnt() -> Column:
    return F.count(F.lit(1)).alias("n_readings")


def production_quality(star: Star) -> DataFrame:
    """Production and quality on the full grain (1:1 by construction): as the warehouse keeps them, else joined."""
    return star.production.join(star.quality, KEYS) if star.wide is None else star.wide


def readings_view(star: Star) -> DataFrame:
    """Flat readings rebuilt from the star (both facts on their common grain,
    machine id from the dimension, timestamp from the time key).  Equal to
    the loaded readings when the load is lossless."""
    cols = ["operation_mode", "efficiency_status", *MEASURES]
    return (production_quality(star)
            .join(star.machine_dim.select("machine_key", "machine_id"), "machine_key")
            .select("machine_id", ts_of_time_key().alias("reading_ts"), *cols))


def with_machine_id(per_machine: DataFrame, star: Star) -> DataFrame:
    """Swap machine_key for machine_id on an already-aggregated frame."""
    return (per_machine.join(star.machine_dim.select("machine_key", "machine_id"), "machine_key")
            .drop("machine_key"))


def _first(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, *[c for c in df.columns if c not in cols])


# Q01 -----------------------------------------------------------------------
def machine_efficiency(star: Star) -> DataFrame:
    """Per machine and efficiency status: mean speed, mean error rate, readings."""
    agg = (star.production.groupBy("machine_key", "efficiency_status")
           .agg(F.avg("speed_uph").alias("avg_speed"), F.avg("error_rate_pct").alias("avg_error_rate"),
                _cnt()))
    out = _first(with_machine_id(agg, star), "machine_id", "efficiency_status")
    return out.orderBy(F.desc("avg_speed"), "machine_id", "efficiency_status")


# Q02 -----------------------------------------------------------------------
def oee_two_factor(star: Star) -> DataFrame:
    """Per machine: speed ratio (mean/max speed) x quality (1 - mean defect %)."""
    agg = (production_quality(star).groupBy("machine_key")
           .agg(safe_ratio(F.avg("speed_uph"), F.max("speed_uph")).alias("speed_ratio"),
                (F.lit(1.0) - F.avg("defect_rate_pct") / 100.0).alias("quality")))
    agg = agg.withColumn("oee", F.col("speed_ratio") * F.col("quality"))
    return _first(with_machine_id(agg, star), "machine_id").orderBy(F.desc("oee"), "machine_id")


# Q03 / Q07 -----------------------------------------------------------------
def defects_by_temperature(star: Star) -> DataFrame:
    """Temperature band -> mean defect rate and readings, highest defect first.
    The reference's machine and time joins do not change the result (every
    fact row has both keys) and are not performed."""
    return (production_quality(star)
            .groupBy(temperature_band("temperature_c").alias("temperature_band"))
            .agg(F.avg("defect_rate_pct").alias("avg_defect_rate"), _cnt())
            .orderBy(F.desc("avg_defect_rate"), "temperature_band"))


def defects_by_temperature_band_order(star: Star) -> DataFrame:
    """As :func:`defects_by_temperature`, rows in band order (coolest first)."""
    return (production_quality(star)
            .groupBy(temperature_band_no("temperature_c").alias("band_no"),
                     temperature_band("temperature_c").alias("temperature_band"))
            .agg(F.avg("defect_rate_pct").alias("avg_defect_rate"), _cnt())
            .orderBy("band_no"))


# Q04 -----------------------------------------------------------------------
def hourly_performance(star: Star) -> DataFrame:
    return (star.production.groupBy(F.hour(ts_of_time_key()).alias("hour"))
            .agg(F.avg("speed_uph").alias("avg_speed"), F.avg("error_rate_pct").alias("avg_error_rate"),
                 _cnt())
            .orderBy("hour"))


# Q05 -----------------------------------------------------------------------
def active_vs_idle(star: Star) -> DataFrame:
    return (star.production.groupBy(operating_state().alias("operating_state"))
            .agg(_cnt(), F.avg("temperature_c").alias("avg_temperature"),
                 F.avg("vibration_hz").alias("avg_vibration"), F.avg("power_kw").alias("avg_power")))


# Q06 -----------------------------------------------------------------------
def top_defect_machines(star: Star, n: int = TOP_N, order: str = "numeric") -> DataFrame:
    """The n machines with the highest mean defect rate.

    ``order='numeric'`` (default) ranks by the number, ties by machine id.
    ``order='text'`` reproduces ranking by the *formatted* text ("9.80%" above
    "10.20%"), which can change which machines make the top n."""
    agg = (star.quality.groupBy("machine_key")
           .agg(F.avg("defect_rate_pct").alias("avg_defect_rate"), _cnt()))
    out = _first(with_machine_id(agg, star), "machine_id")
    key = fmt_pct("avg_defect_rate") if order == "text" else F.col("avg_defect_rate")
    return out.orderBy(key.desc(), "machine_id").limit(n)


# Q08 -----------------------------------------------------------------------
def energy_by_mode(star: Star) -> DataFrame:
    return (star.production.groupBy("operation_mode")
            .agg(F.avg("power_kw").alias("avg_power"), F.min("power_kw").alias("min_power"),
                 F.max("power_kw").alias("max_power"), _cnt())
            .orderBy(F.desc("avg_power"), "operation_mode"))


# Q09 -----------------------------------------------------------------------
def _active_per_machine(star: Star, *aggs: Column) -> DataFrame:
    return star.production.where(is_active()).groupBy("machine_key").agg(*aggs)


def least_energy_efficient(star: Star, n: int = TOP_N, order: str = "numeric") -> DataFrame:
    """Active machines with the highest mean power per unit of speed (the mean
    of per-reading ratios; a zero speed gives no ratio and is skipped).
    Ranked on the unrounded mean; the output shows 9 digits."""
    agg = _active_per_machine(
        star,
        F.avg(safe_ratio("power_kw", "speed_uph")).alias("avg_power_per_unit"),
        F.avg("power_kw").alias("avg_power"), F.avg("speed_uph").alias("avg_speed"))
    out = _first(with_machine_id(agg, star), "machine_id")
    key = fmt_pct("avg_power_per_unit") if order == "text" else F.col("avg_power_per_unit")
    return out.orderBy(key.desc_nulls_last(), "machine_id").limit(n) \
        .withColumn("avg_power_per_unit", F.round("avg_power_per_unit", 9))


# Q10 -----------------------------------------------------------------------
def abnormal_vibration(star: Star) -> DataFrame:
    """Active machines whose mean vibration or its sample st.dev. is high.
    The filter uses the unrounded aggregates; st.dev. is reported to 6 digits."""
    agg = _active_per_machine(
        star, F.avg("vibration_hz").alias("avg_vibration"),
        F.stddev_samp("vibration_hz").alias("sd_vibration"),
        F.max("vibration_hz").alias("max_vibration"), _cnt())
    hit = agg.where((F.col("avg_vibration") > ABNORMAL_VIBRATION_MEAN)
                    | (F.col("sd_vibration") > ABNORMAL_VIBRATION_SD))
    out = _first(with_machine_id(hit, star), "machine_id")
    return (out.withColumn("sd_vibration", F.round("sd_vibration", 6))
            .orderBy(F.desc("avg_vibration"), "machine_id"))


# Q11 -----------------------------------------------------------------------
_PRE_FAILURE = {"temperature_c": "avg_prev_temperature", "vibration_hz": "avg_prev_vibration",
                "power_kw": "avg_prev_power"}


def pre_failure_conditions(star: Star, previous: str = "failure") -> DataFrame:
    """Per machine, the mean temperature / vibration / power of the reading
    *before* each failing reading (error rate above the failure threshold).

    ``previous='failure'`` (default, the analysis as written): the failure
    filter runs first, so "before" means the previous *failing* reading, and a
    machine's first failure has none.  Over a machine's failures f1..fn in
    time order the previous values are those of f1..f(n-1): all failures but
    the last.  So the mean is ``(sum - last) / (count - 1)`` over non-null
    values -- a plain partial aggregation, no sort, no per-machine window.

    ``previous='reading'``: the previous reading of any kind (see
    :func:`previous_reading_values`).
    """
    if previous == "reading":
        return _pre_failure_any_reading(star)
    fails = star.production.where(is_failure())
    aggs = [F.count(F.lit(1)).alias("n_failures")]
    for c in _PRE_FAILURE:
        aggs += [F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}"),
                 F.max_by(c, "time_key").alias(f"_l_{c}")]
    agg = fails.groupBy("machine_key").agg(*aggs)
    cols = []
    for c, name in _PRE_FAILURE.items():
        last_known = F.col(f"_l_{c}").isNotNull()
        num = F.col(f"_s_{c}") - F.when(last_known, F.col(f"_l_{c}")).otherwise(0.0)
        den = F.col(f"_n_{c}") - F.when(last_known, 1).otherwise(0)
        cols.append(F.when(den > 0, num / den).alias(name))
    out = agg.select("machine_key", *cols, "n_failures")
    return _first(with_machine_id(out, star), "machine_id")


#: A machine with up to so many readings is one window group; only those with more are cut into chunks of time.
WHOLE_MACHINE = 500_000


def previous_reading_values(df: DataFrame, cols: list[str], chunk_micros: int = MICROS_PER_HOUR,
                            whole: int = WHOLE_MACHINE) -> DataFrame:
    """``lag(c, 1) over (partition by machine_key order by time_key)`` for each
    column, computed without putting a whole machine into one task.

    Machines with more than ``whole`` rows are cut into (machine, time chunk) groups; the
    others are one group each.  Inside a group the lag is
    an ordinary window, and this shuffle is the only one that all rows take.  For the first row of a chunk, the
    previous row is the last row of the machine's previous non-empty chunk:
    chunk tails are a partial aggregation (one row per chunk), and ordering the
    tails per machine touches one row per chunk, not per reading.
    """
    large = df.groupBy("machine_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole) \
        .select("machine_key", F.lit(True).alias("_large"))  # at most one machine for every ``whole`` rows
    d = df.join(F.broadcast(large), "machine_key", "left") \
        .withColumn("_chunk", F.when(F.col("_large"), F.floor(F.col("time_key") / chunk_micros))).drop("_large")
    w = Window.partitionBy("machine_key", "_chunk").orderBy("time_key")
    inner = d.withColumns({f"_prev_{c}": F.lag(c, 1).over(w) for c in cols}) \
             .withColumn("_first", F.row_number().over(w) == 1)
    tails = (d.where(F.col("_chunk").isNotNull()).groupBy("machine_key", "_chunk")
             .agg(F.max(F.struct("time_key", *cols)).alias("_tail")))
    tw = Window.partitionBy("machine_key").orderBy("_chunk")
    prev_tail = (tails.withColumn("_prev_tail", F.lag("_tail", 1).over(tw))
                 .select("machine_key", "_chunk", "_prev_tail"))
    joined = inner.join(prev_tail, ["machine_key", "_chunk"], "left")
    return joined.select(
        *[c for c in df.columns],
        *[F.when(F.col("_first"), F.col(f"_prev_tail.{c}")).otherwise(F.col(f"_prev_{c}")).alias(f"prev_{c}")
          for c in cols])


def _pre_failure_any_reading(star: Star) -> DataFrame:
    cols = list(_PRE_FAILURE)
    base = star.production.select("machine_key", "time_key", "error_rate_pct", *cols)
    prev = previous_reading_values(base, cols).where(is_failure())
    agg = prev.groupBy("machine_key").agg(
        *[F.avg(f"prev_{c}").alias(n) for c, n in _PRE_FAILURE.items()],
        F.count(F.lit(1)).alias("n_failures"))
    return _first(with_machine_id(agg, star), "machine_id")


# Q12 -----------------------------------------------------------------------
def oee_three_factor(star: Star) -> DataFrame:
    """Flagship OEE per machine = availability x performance x quality.

    availability: share of readings in Active mode; performance: mean / max
    speed; quality: 1 - mean defect rate / 100.  One pass over the joined
    facts, one partial+final aggregation keyed by machine."""
    agg = (production_quality(star).groupBy("machine_key")
           .agg(F.avg(F.when(is_active(), 1.0).otherwise(0.0)).alias("availability"),
                safe_ratio(F.avg("speed_uph"), F.max("speed_uph")).alias("performance"),
                (F.lit(1.0) - F.avg("defect_rate_pct") / 100.0).alias("quality"),
                _cnt()))
    agg = agg.withColumn("oee", F.col("availability") * F.col("performance") * F.col("quality"))
    out = with_machine_id(agg, star).select(
        "machine_id", "availability", "performance", "quality", "oee", "n_readings")
    return out.orderBy(F.desc("oee"), "machine_id")


# Q13 -----------------------------------------------------------------------
def daily_trend(star: Star) -> DataFrame:
    return (production_quality(star)
            .groupBy(F.to_date(ts_of_time_key()).alias("reading_date"))
            .agg(F.avg("speed_uph").alias("avg_speed"), F.avg("error_rate_pct").alias("avg_error_rate"),
                 F.avg("defect_rate_pct").alias("avg_defect_rate"), _cnt())
            .orderBy("reading_date"))


# Q14 -----------------------------------------------------------------------
def weekday_vs_weekend(star: Star) -> DataFrame:
    return (star.production.groupBy(day_type(ts_of_time_key()).alias("day_type"))
            .agg(F.avg("speed_uph").alias("avg_speed"), F.avg("error_rate_pct").alias("avg_error_rate"),
                 F.avg("power_kw").alias("avg_power"), _cnt()))


# Q15 -----------------------------------------------------------------------
_STATUS_COLS = ["operation_mode", "temperature_c", "vibration_hz", "speed_uph",
                "error_rate_pct", "efficiency_status"]


def latest_status(star: Star) -> DataFrame:
    """Last reading of every machine: the largest time key per machine (a hash
    aggregate over one long, with a map-side partial step), joined back on the
    unique pair of keys."""
    last = star.production.groupBy("machine_key").agg(F.max("time_key").alias("time_key"))
    flat = star.production.join(last, KEYS).select("machine_key", *_STATUS_COLS, ts_of_time_key().alias("reading_ts"))
    return _first(with_machine_id(flat, star), "machine_id").orderBy("machine_id")


def latest_status_of(wh) -> DataFrame:
    """:func:`latest_status` from a warehouse: the rollups say on which day each machine was last heard, so only
    the date partitions of those days are read, however long the history is and however
    long a machine has been silent.  The days (bounded by the calendar) are literals on the partition column."""
    days = [r["day"] for r in last_days(wh.rollups()).select("day").distinct().collect()]
    return latest_status(wh.star()._replace(production=wh.on_days("production_fact", days)))


# Q16 -----------------------------------------------------------------------
ALERT_KINDS = ("high temperature", "excessive vibration")


def alerts(star: Star) -> DataFrame:
    """Readings above the temperature limit and readings above the vibration
    limit (a reading above both yields two alerts), newest first.

    One scan: the OR of both limits is pushed to Parquet, then each row
    expands to the alerts it raises (no union of two scans)."""
    hot = F.col("temperature_c") > HIGH_TEMPERATURE_C
    shaky = F.col("vibration_hz") > HIGH_VIBRATION_HZ
    cand = star.production.where(hot | shaky).select(
        "machine_key", "time_key",
        F.filter(F.array(
            F.struct(hot.alias("hit"), F.lit(ALERT_KINDS[0]).alias("alert_kind"),
                     F.col("temperature_c").alias("alert_value")),
            F.struct(shaky.alias("hit"), F.lit(ALERT_KINDS[1]).alias("alert_kind"),
                     F.col("vibration_hz").alias("alert_value"))),
            lambda x: x["hit"]).alias("_a"))
    rows = cand.select("machine_key", "time_key", F.inline("_a")).drop("hit")
    out = with_machine_id(rows, star).select(
        "machine_id", "alert_kind", "alert_value", ts_of_time_key().alias("reading_ts"))
    return out.orderBy(F.desc("reading_ts"), "machine_id", "alert_kind")


# Q17 -----------------------------------------------------------------------
def productivity_ranking(star: Star) -> DataFrame:
    """Active machines ranked three ways: speed (high first), error rate and
    power per unit (low first), on unrounded values."""
    agg = _active_per_machine(
        star, F.avg("speed_uph").alias("avg_speed"), F.avg("error_rate_pct").alias("avg_error_rate"),
        F.avg(safe_ratio("power_kw", "speed_uph")).alias("avg_power_per_unit"))
    return ranking_report(with_machine_id(agg, star))


# Q18 -----------------------------------------------------------------------
_SD = {"speed_uph": "sd_speed", "temperature_c": "sd_temperature", "vibration_hz": "sd_vibration"}


def deviant_machines(star: Star) -> DataFrame:
    """Active machines whose st.dev. of speed, temperature or vibration is above
    the fleet mean of that st.dev.  The per-machine frame is built once (with
    its machine id) and feeds both the one-row fleet means -- broadcast back,
    a proven single row -- and the filter, so the two uses are one identical
    subtree and the planner reuses its shuffle instead of scanning twice."""
    sd = with_machine_id(
        _active_per_machine(star, *[F.stddev_samp(c).alias(n) for c, n in _SD.items()]), star)
    means = sd.agg(*[F.avg(n).alias(f"mean_{n}") for n in _SD.values()])
    cond = None
    for n in _SD.values():
        c = F.col(n) > F.col(f"mean_{n}")
        cond = c if cond is None else cond | c
    hit = sd.crossJoin(F.broadcast(means)).where(cond)
    cols = list(_SD.values()) + [f"mean_{n}" for n in _SD.values()]
    out = hit.select("machine_id", *[F.round(c, 6).alias(c) for c in cols])
    return out.orderBy(F.desc("sd_speed"), "machine_id")


ANALYSES = {
    "machine_efficiency": machine_efficiency,
    "oee_two_factor": oee_two_factor,
    "defects_by_temperature": defects_by_temperature,
    "hourly_performance": hourly_performance,
    "active_vs_idle": active_vs_idle,
    "top_defect_machines": top_defect_machines,
    "defects_by_temperature_band_order": defects_by_temperature_band_order,
    "energy_by_mode": energy_by_mode,
    "least_energy_efficient": least_energy_efficient,
    "abnormal_vibration": abnormal_vibration,
    "pre_failure_conditions": pre_failure_conditions,
    "oee_three_factor": oee_three_factor,
    "daily_trend": daily_trend,
    "weekday_vs_weekend": weekday_vs_weekend,
    "latest_status": latest_status,
    "alerts": alerts,
    "productivity_ranking": productivity_ranking,
    "deviant_machines": deviant_machines,
}


VIEWS = ("machine_dim", "time_dim", "production_fact", "quality_fact")


def run(star: Star, query: str) -> DataFrame:
    """An analysis by name, or SQL text over the star's tables under their
    stable names (``VIEWS``, as temporary views of the session)."""
    if query in ANALYSES:
        return ANALYSES[query](star)
    for name, frame in zip(VIEWS, (star.machine_dim, star.time_dim, star.production, star.quality), strict=True):
        frame.createOrReplaceTempView(name)
    return star.production.sparkSession.sql(query)
