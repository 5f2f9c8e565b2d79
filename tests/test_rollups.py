"""Rollups, the wide fact and what is answered from them: equal to the facts, whatever the loads."""

from __future__ import annotations

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from plantpulse.operators import analytics as A, charts, fleet, ranking, rollups as R
from plantpulse.operators.clean import as_converted
from plantpulse.plans.config import checkpoint_root
from plantpulse.plans.inspect import plan_text
from plantpulse.registry import QUERIES
from plantpulse.schema import READINGS
from plantpulse.sources.fixture import sensor_readings
from plantpulse.sources.warehouse import Warehouse
from plantpulse.warehouses import clean_warehouse, dirty_warehouse, incremental_warehouse

FACT_WAY = {**A.ANALYSES, "fleet_oee": fleet.fleet_oee, "failure_rate": fleet.failure_rate, "mtbf": fleet.mtbf,
            "mtbf_by_machine": fleet.mtbf_by_machine}


def rows(df):
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(near(v) for v in r) for r in df.collect()), key=repr)


def fresh(spark, *loads, grain="day"):
    wh = Warehouse(spark, f"{checkpoint_root(spark)}/plantpulse-tests/{uuid.uuid4().hex}", date_grain=grain)
    for df in loads:
        wh.load(df)
    return wh


@pytest.mark.parametrize("name", sorted(R.ROLLED_UP))
@pytest.mark.parametrize("make", [dirty_warehouse, incremental_warehouse])
def test_rollups_answer_like_the_facts(spark, make, name):
    wh = make(spark, SF_SMALL)
    got, want = R.ROLLED_UP[name](wh.rollups()), FACT_WAY[name](wh.star())
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(R.ROLLED_UP))
def test_no_fact_file_is_read(spark, name):
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    assert "rollup" in text and "_fact" not in text


def test_rollups_with_nulls_and_without_rows(spark, edge_readings):
    for wh in (fresh(spark, as_converted(edge_readings)), fresh(spark, as_converted(edge_readings.limit(0)))):
        for name, fn in R.ROLLED_UP.items():
            assert rows(fn(wh.rollups())) == rows(FACT_WAY[name](wh.star())), name


def reading(i, machine, ts, **values):
    base = dict(reading_id=i, machine_id=machine, reading_ts=ts, operation_mode="Active", efficiency_status="Low")
    return tuple({**base, **{f.name: 1.0 for f in READINGS.fields if f.name not in base}, **values}[f.name] for f in READINGS.fields)


def test_second_moments_merge_far_from_zero(spark):
    rnd, start = random.Random(3), dt.datetime(2024, 1, 1)
    data = [reading(i, i % 2, start + dt.timedelta(minutes=7 * i), vibration_hz=1e7 + rnd.gauss(0, 0.5)) for i in range(900)]
    df = spark.createDataFrame(data, READINGS)
    wh = fresh(spark, *[as_converted(df.where(F.col("reading_id") % 3 == k)) for k in range(3)], grain="month")
    agg = R.with_deviations(wh.rollups().production, ["machine_key"], ["vibration_hz"]).groupBy("machine_key").agg(R.deviation("vibration_hz").alias("sd"))
    want = {r["machine_key"]: r["sd"] for r in wh.star().production.groupBy("machine_key").agg(F.stddev_samp("vibration_hz").alias("sd")).collect()}
    got = {r["machine_key"]: r["sd"] for r in agg.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert wh.rollups().production.groupBy("machine_key", "day", "hour").count().where("count > 1").count() > 0  # loads share hours


def test_wide_fact_holds_the_readings_of_both_facts(spark):
    for wh in (dirty_warehouse(spark, SF_SMALL), incremental_warehouse(spark, SF_SMALL)):
        star = wh.star()
        assert rows(star.wide.drop("load_ts")) == rows(star.production.drop("load_ts").join(star.quality.drop("load_ts"), A.KEYS).select(
            *star.wide.drop("load_ts").columns))
        assert star.wide.count() < star.production.count()


def test_a_later_load_completes_a_reading(spark):
    ts = dt.datetime(2024, 3, 1, 10)
    conv = as_converted(spark.createDataFrame([reading(1, 1, ts), reading(2, 1, ts + dt.timedelta(hours=1)), reading(3, 1, ts + dt.timedelta(hours=2))], READINGS))
    bad = F.lit("bad")
    wh = fresh(spark, conv.withColumn("quality_reason", F.when(F.col("reading_id") == 1, bad)).withColumn(
        "production_reason", F.when(F.col("reading_id") == 2, bad)))
    assert (wh.star().production.count(), wh.star().quality.count(), wh.star().wide.count()) == (2, 2, 1)
    wh.load(conv)
    assert (wh.star().production.count(), wh.star().quality.count(), wh.star().wide.count()) == (3, 3, 3)
    wh.load(conv)
    assert wh.star().wide.count() == 3 and rows(R.oee_three_factor(wh.rollups())) == rows(A.oee_three_factor(wh.star()))


@pytest.mark.parametrize("fn", [A.oee_two_factor, A.defects_by_temperature, A.defects_by_temperature_band_order, A.oee_three_factor, A.daily_trend])
def test_queries_on_both_facts_do_not_join_them(spark, fn):
    text = plan_text(fn(clean_warehouse(spark, SF_SMALL).star()))
    below = text[text.index("partial_"):]
    assert "wide_fact" in below and "production_fact" not in text and "Exchange" not in below.split("FileScan")[0]


def test_latest_status_reads_the_days_that_matter(spark):
    start = dt.datetime(2023, 1, 1)
    data = [reading(d * 10 + m, m, start + dt.timedelta(days=d, hours=m), speed_uph=float(d)) for d in range(60) for m in (1, 2)]
    data += [reading(9000, 3, start + dt.timedelta(days=2, hours=5), speed_uph=777.0)]  # silent ever since
    wh = fresh(spark, as_converted(spark.createDataFrame(data, READINGS)))
    got = A.latest_status_of(wh)
    assert rows(got) == rows(A.latest_status(wh.star()))
    assert {r["machine_id"]: r["speed_uph"] for r in got.collect()} == {1: 59.0, 2: 59.0, 3: 777.0}
    read = {f.split("reading_date=")[1].split("/")[0] for f in wh.on_days("production_fact", [
        r["day"] for r in R.last_days(wh.rollups()).collect()]).inputFiles()}
    assert read == {"2023-03-01", "2023-01-03"}
    assert "PartitionFilters" in plan_text(got) and A.latest_status_of(fresh(spark)).count() == 0


def test_ranking_is_one_pass(spark):
    text = plan_text(QUERIES["productivity_ranking"](spark, SF_SMALL))
    exchanges = [x for x in text.splitlines() if "Exchange " in x and "BroadcastExchange" not in x]
    assert len(exchanges) <= 4 and text.count("Window [") == 1


def test_positions_against_plain_ranks(spark):
    rnd = random.Random(2)
    data = [(i, rnd.choice([None, 1.0, 2.0, rnd.random(), rnd.gauss(0, 9)]), rnd.choice([5.0, float(i)])) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, a double, b double")
    got = {(r["id"], r["rank"]): (r["before"], r["ties"]) for r in ranking.positions(df, ["id"], {"a": F.col("a"), "b": F.col("b")}).collect()}
    for k, name in ((1, "a"), (2, "b")):
        values = sorted(float("-inf") if r[k] is None else r[k] for r in data)
        import bisect

        for r in data[::7]:
            v = float("-inf") if r[k] is None else r[k]
            assert got[r[0], name] == (bisect.bisect_left(values, v), values.count(v))
    assert ranking.positions(df.limit(0), ["id"], {"a": F.col("a")}).count() == 0


def test_domains_and_bins_read_their_input_once(spark):
    r = sensor_readings(spark, SF_SMALL)
    assert plan_text(charts.filter_domains(r)).count("FileScan") == 1
    text = plan_text(charts.score_histogram(r), final=True).split("Initial Plan")[0]
    assert text.count("FileScan") == 1 and "ReusedExchange" in text


def test_domains_with_nulls_and_without_rows(spark):
    ts = dt.datetime(2024, 5, 6, 7)
    df = spark.createDataFrame([reading(1, 4, ts, operation_mode=None), reading(2, None, ts, operation_mode="B"), reading(3, 4, ts, operation_mode="A")], READINGS)
    got = [tuple(x) for x in charts.filter_domains(df).collect()]
    assert set(got) == {("date", 0, "2024-05-06"), ("date", 1, "2024-05-06"), ("machine", None, None), ("machine", 4, "4"),
                        ("mode", 0, None), ("mode", 1, "A"), ("mode", 2, "B")}
    assert charts.filter_domains(df.limit(0)).count() == 0
    assert charts.score_histogram(df.limit(0)).count() == 0


def test_rollups_dealt_to_several_tasks_are_the_same(spark, monkeypatch):
    readings = as_converted(sensor_readings(spark, SF_SMALL))
    monkeypatch.setattr(R, "ROWS_A_TASK", 300)
    n = readings.count()
    assert 1 < R.tasks_for(n) == -(-n // 300) and R.tasks_for(0) == 1
    dealt = fresh(spark, readings)
    for name, fn in R.ROLLED_UP.items():
        assert rows(fn(dealt.rollups())) == rows(FACT_WAY[name](dealt.star())), name
    for made, bare in ((R.production_rollup, dealt.star().production), (R.paired_rollup, dealt.star().wide)):
        assert plan_text(made(bare, 4)).count("Exchange hashpartitioning") == 1
        assert rows(made(bare, 4)) == rows(made(bare))
