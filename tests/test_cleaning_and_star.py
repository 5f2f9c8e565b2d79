"""Cleaning with rejects, the star loader and its idempotency."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from plantpulse.operators.clean import as_converted, convert, fill_missing, null_profile, rejects, strict_check
from plantpulse.operators.star import build_star, dense_keys, empty_star, union_star
from plantpulse.plans.config import checkpoint_root
from plantpulse.sources.fixture import dirty_raw, sensor_readings
from plantpulse.sources.warehouse import Warehouse


@pytest.fixture(scope="module")
def raw(spark):
    return dirty_raw(sensor_readings(spark, SF_SMALL)).cache()


def test_fault_counts(raw):
    assert raw.count() == 1012
    assert raw.where(F.col("machine_id") == "bad").count() == 6
    assert raw.where(F.col("reading_ts").isNull()).count() == 11
    assert raw.where(F.col("temperature_c").isNull()).count() == 12
    assert raw.where(F.col("temperature_c") == "bad").count() == 9
    assert raw.where(F.col("defect_rate_pct") == "bad").count() == 11


def test_null_profile_only_columns_with_nulls(raw):
    got = {r["column_name"]: r["n_null"] for r in null_profile(raw).collect()}
    # the last two hold texts that stand for a missing value
    assert got == {"reading_ts": 11, "temperature_c": 12, "power_kw": 11, "latency_ms": 9}


def test_fill_zero_mode_reproduces_epoch(raw):
    filled = fill_missing(raw, timestamp="zero")
    assert filled.where(F.col("reading_ts") == "1970-01-01 00:00:00").count() == 11
    assert filled.where(F.col("temperature_c").isNull()).count() == 0


def test_rejects_plus_good_is_raw(raw):
    conv = convert(raw)
    rej = rejects(conv)
    good_any = conv.where(F.col("production_reason").isNull() | F.col("quality_reason").isNull())
    assert rej.count() + good_any.count() - rej.where(F.col("target") != "both").count() == raw.count()
    reasons = {r["reason"] for r in rej.select("reason").distinct().collect()}
    assert {"bad machine_id", "missing reading_ts", "bad temperature_c", "bad defect_rate_pct"} <= reasons
    # a bad defect rate only keeps the row out of the quality fact
    row = rej.where(F.col("reason") == "bad defect_rate_pct").first()
    assert row["target"] == "quality"


def test_strict_mode_raises(raw):
    with pytest.raises(ValueError):
        strict_check(convert(raw))


def test_star_counts_and_uniqueness(spark, raw):
    star = build_star(convert(raw), empty_star(spark))
    assert star.machine_dim.count() == 15
    assert star.time_dim.count() == 986
    assert star.production.count() == 977
    assert star.quality.count() == 977
    for fact in (star.production, star.quality):
        assert fact.groupBy("machine_key", "time_key").count().where("count > 1").count() == 0


def test_dense_keys_across_blocks(spark):
    ids = spark.createDataFrame([(i,) for i in (-5, 1, 2, 70000, 200000, 65535, 65536)], "machine_id int")
    start = spark.createDataFrame([(10,)], "start long")
    got = {r["machine_id"]: r["machine_key"] for r in dense_keys(ids, "machine_id", "machine_key", start).collect()}
    assert [got[i] for i in sorted(got)] == list(range(11, 18))


def test_incremental_load_is_idempotent(spark, raw):
    conv = convert(raw)
    wh = Warehouse(spark, f"{checkpoint_root(spark)}/plantpulse-tests/{uuid.uuid4().hex}")
    even, odd = conv.where(F.col("reading_id") % 2 == 0), conv.where(F.col("reading_id") % 2 == 1)
    wh.load(even)
    wh.load(odd)
    before = [t.count() for t in wh.star()]
    wh.load(even)
    after = [t.count() for t in wh.star()]
    assert before == after
    one_shot = build_star(conv, empty_star(spark))
    nat = lambda s: s.production.join(s.machine_dim, "machine_key").select(
        "machine_id", "time_key", "speed_uph")
    # same content on natural keys (surrogate machine keys depend on load order)
    assert sorted(nat(wh.star()).collect()) == sorted(nat(one_shot).collect())


def test_in_memory_incremental_continues_keys(spark, edge_readings):
    first = build_star(as_converted(edge_readings.where("machine_id < 3")), empty_star(spark))
    second = build_star(as_converted(edge_readings), first)
    assert [r["machine_key"] for r in second.machine_dim.collect()] == [3]
    assert second.production.count() == 1
    both = union_star(first, second)
    assert both.production.count() == 7


def test_csv_messy_cells_become_rejects_not_failures(spark, tmp_path):
    header = ("Timestamp,Machine_ID,Operation_Mode,Temperature_C,Vibration_Hz,Power_Consumption_kW,"
              "Network_Latency_ms,Packet_Loss_%,Quality_Control_Defect_Rate_%,Production_Speed_units_per_hr,"
              "Predictive_Maintenance_Score,Error_Rate_%,Efficiency_Status")
    lines = [header,
             "2024-01-01 00:00:00,1,Active,50,2,3,10,1,2,100,0.5,1,Low",
             "2024-01-01 00:01:00,x1,Active,50,2,3,10,1,2,100,0.5,1,Low",        # bad machine id
             "not a time,2,Idle,50,2,3,10,1,2,100,0.5,1,High",                  # bad timestamp
             "2024-01-01 00:02:00,2,Idle,,2,3,10,1,oops,100,0.5,1,",             # missing temp, bad defect
             '"2024-01-01 00:03:00",3,"Active",51.5,2,3,10,1,2,100,0.5,1,"Medium"']
    path = tmp_path / "in.csv"
    path.write_text("\n".join(lines) + "\n")
    from plantpulse.sources.files import read_csv

    conv = convert(read_csv(spark, str(path)))
    got = {(r["machine_id"], r["target"], r["reason"]) for r in
           conv.join(rejects(conv), "reading_id").select("machine_id", "target", "reason").collect()}
    assert got == {(None, "both", "bad machine_id"), (2, "both", "bad reading_ts"),
                   (2, "quality", "bad defect_rate_pct")}
    filled = conv.where("machine_id = 2 AND reading_ts IS NOT NULL").first()
    assert filled["temperature_c"] == 0.0 and filled["efficiency_status"] == "0"
    assert conv.where("machine_id = 3").first()["temperature_c"] == 51.5


def test_layout_is_stored_with_the_data(spark):
    conv = as_converted(sensor_readings(spark, SF_SMALL))
    root = f"{checkpoint_root(spark)}/plantpulse-tests/{uuid.uuid4().hex}"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    Warehouse(spark, root, date_grain="month").load(conv, with_rejects=False)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        wh = Warehouse(spark, root)  # another width, no grain named
        s = wh.star()
        assert s.production.join(s.quality, ["machine_key", "time_key"]).count() == 1000
        assert wh.star_between(dt.date(2024, 1, 8), dt.date(2024, 1, 21)).production.count() == 1000  # one month, one partition
        wh.load(conv, with_rejects=False)
        assert wh.star().production.count() == 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    with pytest.raises(ValueError):
        Warehouse(spark, root, date_grain="day").star()


def test_two_builders_publish_one_set_of_rows(spark):
    from plantpulse.warehouses import _once

    root = f"{checkpoint_root(spark)}/plantpulse-tests/{uuid.uuid4().hex}"

    def build(path, inner=False):
        if not inner:  # another builder starts and ends meanwhile
            _once(spark, root, lambda p: build(p, True))
        spark.range(5).write.parquet(path)

    path = _once(spark, root, build)
    assert spark.read.parquet(path).count() == 5
    assert _once(spark, root, lambda p: 1 / 0) == path


def test_fingerprint_sees_nested_files(spark, tmp_path):
    from plantpulse.warehouses import input_fingerprint

    nested = tmp_path / "events.parquet" / "a"
    nested.mkdir(parents=True)
    (nested / "x").write_text("1")
    first = input_fingerprint(spark, str(tmp_path))
    (nested / "y").write_text("2")
    assert input_fingerprint(spark, str(tmp_path)) != first


def test_missing_texts_and_non_finite_numbers(spark):
    from plantpulse.schema import RAW

    base = {f.name: "1" for f in RAW.fields} | {"reading_ts": "2024-01-01 00:00:00", "reading_id": 0}
    cells = [{"temperature_c": "NaN"}, {"temperature_c": "null"}, {"temperature_c": "inf"}, {"machine_id": "NA"}]
    raw = spark.createDataFrame([tuple({**base, **c, "reading_id": i}[f.name] for f in RAW.fields)
                                 for i, c in enumerate(cells)], RAW)
    got = {r["reading_id"]: r for r in convert(raw).collect()}
    assert got[0]["temperature_c"] == got[1]["temperature_c"] == 0.0 and got[0]["production_reason"] is None
    assert got[2]["temperature_c"] is None and got[2]["production_reason"] == "bad temperature_c"
    assert got[3]["key_reason"] == "missing machine_id"
    zero = {r["reading_id"]: r for r in convert(raw, timestamp="zero").collect()}
    assert zero[3]["machine_id"] == 0 and zero[3]["key_reason"] is None


def test_etl_as_a_script_and_empty_source(spark, tmp_path):
    import os
    import subprocess
    import sys

    script = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "plantpulse", "etl.py")
    done = subprocess.run([sys.executable, script, "--help"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and "--warehouse" in done.stdout
    from plantpulse.etl import run_etl

    (tmp_path / "empty.csv").write_text("Timestamp\n")
    with pytest.raises(ValueError):
        run_etl(spark, str(tmp_path / "empty.csv"), f"{checkpoint_root(spark)}/plantpulse-tests/{uuid.uuid4().hex}")
