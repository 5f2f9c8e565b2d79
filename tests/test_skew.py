"""One machine holding a third of all readings: the rewrites stay exact and
the hot machine's lag work is split over many (machine, chunk) groups."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from plantpulse.operators import analytics as A
from plantpulse.operators import fleet as K
from plantpulse.operators.clean import as_converted
from plantpulse.operators.star import build_star, empty_star
from plantpulse.sources.fixture import sensor_readings


@pytest.fixture(scope="module")
def hot_star(spark):
    r = sensor_readings(spark, SF_SMALL)
    # every third reading moves to machine 1 (timestamps stay unique per machine)
    hot = r.withColumn("machine_id", F.when(F.col("reading_id") % 3 == 0, F.lit(1)).otherwise(F.col("machine_id")))
    assert hot.where("machine_id = 1").count() > hot.count() / 3
    return build_star(as_converted(hot), empty_star(spark))


def test_rewrites_exact_under_skew(hot_star):
    p = hot_star.production.join(hot_star.machine_dim, "machine_key")
    w = Window.partitionBy("machine_id").orderBy("time_key")
    fails = p.where(F.col("error_rate_pct") > 5)
    expect = {r[0]: r[1] for r in fails.select("machine_id", F.lag("power_kw").over(w).alias("x"))
              .groupBy("machine_id").agg(F.avg("x")).collect()}
    got = {r["machine_id"]: r["avg_prev_power"] for r in A.pre_failure_conditions(hot_star).collect()}
    assert got.keys() == expect.keys()
    assert all((got[m] is None and expect[m] is None) or abs(got[m] - expect[m]) < 1e-9 for m in got)
    gaps = {r[0]: r[1] for r in fails.select("machine_id", (F.col("time_key") - F.lag("time_key").over(w)).alias("g"))
            .groupBy("machine_id").agg(F.avg("g") / 3.6e9).collect()}
    for r in K.mtbf_by_machine(hot_star).collect():
        e = gaps[r["machine_id"]]
        assert (r["mtbf_hours"] is None and e is None) or abs(r["mtbf_hours"] - e) < 1e-9


def test_hot_machine_lag_is_split_into_chunks(hot_star):
    base = hot_star.production.select("machine_key", "time_key", "temperature_c")
    hot_key = hot_star.machine_dim.where("machine_id = 1").first()["machine_key"]
    chunks = (base.where(F.col("machine_key") == hot_key)
              .select(F.floor(F.col("time_key") / 3_600_000_000)).distinct().count())
    assert chunks > 100  # the hot machine's rows spread over >100 independent window groups
    w = Window.partitionBy("machine_key").orderBy("time_key")
    expect = {(r[0], r[1]): r[2] for r in base.select("machine_key", "time_key", F.lag("temperature_c").over(w)).collect()}
    got = A.previous_reading_values(base, ["temperature_c"])
    assert {(r["machine_key"], r["time_key"]): r["prev_temperature_c"] for r in got.collect()} == expect


def test_only_large_machines_are_cut_into_chunks(hot_star):
    base = hot_star.production.select("machine_key", "time_key", "temperature_c")
    per = {r[0]: r[1] for r in base.groupBy("machine_key").count().collect()}
    whole = sorted(per.values())[-2]  # all machines but the largest
    w = Window.partitionBy("machine_key").orderBy("time_key")
    expect = {(r[0], r[1]): r[2] for r in base.select("machine_key", "time_key", F.lag("temperature_c").over(w)).collect()}
    for limit in (0, whole):
        got = A.previous_reading_values(base, ["temperature_c"], whole=limit)
        assert {(r["machine_key"], r["time_key"]): r["prev_temperature_c"] for r in got.collect()} == expect
