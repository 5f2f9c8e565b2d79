"""Hand-checked expectations on the seven-row edge frame (semantic traps)."""

from __future__ import annotations

import pytest

from plantpulse.operators import analytics as A
from plantpulse.operators import fleet as K


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_temperature_bands_first_match_inclusive_null_to_hottest(edge_star):
    rows = by(A.defects_by_temperature(edge_star), "temperature_band")
    assert rows["low (<50)"]["avg_defect_rate"] == 10.0 and rows["low (<50)"]["n_readings"] == 1
    assert rows["normal (50-70)"]["avg_defect_rate"] == pytest.approx(5.2666667, abs=1e-6)
    assert rows["normal (50-70)"]["n_readings"] == 3
    assert rows["high (70-85)"]["avg_defect_rate"] == 6.0 and rows["high (70-85)"]["n_readings"] == 1
    assert rows["very high (>85)"]["avg_defect_rate"] == 5.5 and rows["very high (>85)"]["n_readings"] == 2


def test_band_order(edge_star):
    got = [r["band_no"] for r in A.defects_by_temperature_band_order(edge_star).collect()]
    assert got == [1, 2, 3, 4]


def test_top_defects_numeric_vs_text_order(edge_star):
    assert [r["machine_id"] for r in A.top_defect_machines(edge_star).collect()] == [2, 3, 1]
    assert [r["machine_id"] for r in A.top_defect_machines(edge_star, order="text").collect()] == [3, 1, 2]


def test_energy_per_unit_skips_zero_speed(edge_star):
    rows = by(A.least_energy_efficient(edge_star), "machine_id")
    assert rows[1]["avg_power_per_unit"] == pytest.approx(0.03)
    assert rows[2]["avg_power_per_unit"] == pytest.approx(0.02)
    assert rows[3]["avg_power_per_unit"] == pytest.approx(0.001)


def test_abnormal_vibration(edge_star):
    rows = by(A.abnormal_vibration(edge_star), "machine_id")
    assert set(rows) == {1, 3}
    assert rows[1]["avg_vibration"] == 4.75 and rows[1]["sd_vibration"] == 0.25 and rows[1]["n_readings"] == 3
    assert rows[3]["avg_vibration"] == 4.0 and rows[3]["sd_vibration"] is None


def test_pre_failure_previous_failure(edge_star):
    rows = by(A.pre_failure_conditions(edge_star), "machine_id")
    assert set(rows) == {1, 2}
    assert rows[1]["avg_prev_temperature"] == 67.5 and rows[1]["n_failures"] == 3
    assert rows[2]["avg_prev_temperature"] is None and rows[2]["n_failures"] == 1


def test_pre_failure_previous_reading(edge_star):
    rows = by(A.pre_failure_conditions(edge_star, previous="reading"), "machine_id")
    assert rows[1]["avg_prev_temperature"] == 77.5 and rows[1]["n_failures"] == 3
    assert rows[2]["avg_prev_temperature"] == 49.75 and rows[2]["n_failures"] == 1


def test_oee_three_factor(edge_star):
    rows = by(A.oee_three_factor(edge_star), "machine_id")
    assert rows[1]["oee"] == pytest.approx(0.31828125)
    assert rows[2]["oee"] == pytest.approx(0.4475)
    assert rows[3]["oee"] == pytest.approx(0.902)


def test_weekend_split(edge_star):
    rows = by(A.weekday_vs_weekend(edge_star), "day_type")
    assert rows["weekend"]["avg_speed"] == 150.0 and rows["weekend"]["n_readings"] == 3
    assert rows["weekday"]["avg_speed"] == 437.5 and rows["weekday"]["n_readings"] == 4


def test_latest_status(edge_star):
    rows = by(A.latest_status(edge_star), "machine_id")
    assert str(rows[1]["reading_ts"]) == "2024-01-08 06:30:00"
    assert rows[2]["operation_mode"] is None and rows[2]["error_rate_pct"] == 12.0
    assert rows[3]["speed_uph"] == 1000.0


def test_alerts_strict_limits_and_double_alert(edge_star):
    got = sorted((r["machine_id"], r["alert_kind"], r["alert_value"]) for r in A.alerts(edge_star).collect())
    assert got == [(1, "excessive vibration", 4.75), (1, "excessive vibration", 5.0),
                   (1, "high temperature", 85.25)]


def test_rankings(edge_star):
    rows = by(A.productivity_ranking(edge_star), "machine_id")
    assert [(rows[m]["speed_rank"], rows[m]["error_rank"], rows[m]["energy_rank"]) for m in (1, 2, 3)] == \
        [(3, 3, 3), (2, 2, 2), (1, 1, 1)]


def test_deviant_machines_empty(edge_star):
    assert A.deviant_machines(edge_star).count() == 0


def test_mtbf_by_machine(edge_star):
    rows = by(K.mtbf_by_machine(edge_star), "machine_id")
    assert rows[1]["mtbf_hours"] == pytest.approx(27.258333, abs=1e-6)
    assert rows[2]["mtbf_hours"] is None


def test_chunked_lag_matches_plain_window(spark, edge_star):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    base = edge_star.production.select("machine_key", "time_key", "temperature_c")
    w = Window.partitionBy("machine_key").orderBy("time_key")
    expect = {(r[0], r[1]): r[2] for r in
              base.select("machine_key", "time_key", F.lag("temperature_c").over(w)).collect()}
    for chunk in (60_000_000, 3_600_000_000, 86_400_000_000 * 30):
        got = A.previous_reading_values(base, ["temperature_c"], chunk_micros=chunk)
        assert {(r["machine_key"], r["time_key"]): r["prev_temperature_c"] for r in got.collect()} == expect
