"""Physical-plan shape: what must (not) appear for each query to scale."""

from __future__ import annotations

import re

import pytest

from conftest import SF_SMALL
from plantpulse.operators import analytics as A
from plantpulse.plans.inspect import assert_no_python_udf, plan_text
from plantpulse.registry import QUERIES
from plantpulse.warehouses import clean_warehouse

NO_MODEL = [n for n in QUERIES if n not in ("efficiency_scores", "failure_scores", "model_metrics")]


@pytest.fixture(scope="module")
def star(spark):
    return clean_warehouse(spark, SF_SMALL).star()


@pytest.mark.parametrize("name", NO_MODEL)
def test_no_python_udf(spark, name):
    assert_no_python_udf(QUERIES[name](spark, SF_SMALL))


@pytest.mark.parametrize("fn", [A.top_defect_machines, A.least_energy_efficient])
def test_top_k_without_full_sort(star, fn):
    assert "TakeOrderedAndProject" in plan_text(fn(star))


def _scans(text: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet \S*{table}\[", text))


def test_alerts_single_scan(star):
    assert _scans(plan_text(A.alerts(star)), "production_fact") == 1


def test_no_window_over_readings(star):
    # latest status and previous-failure values are aggregations, not windows
    for fn in (A.latest_status, A.pre_failure_conditions):
        assert "Window" not in plan_text(fn(star))


def test_fact_join_tasks_follow_the_data(spark, star):
    # shuffled on the pair of keys, in as many tasks as the session asks for: no fixed bucket count
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        # (a star without the wide fact, as built in memory)
        text = plan_text(A.production_quality(star._replace(wide=None)).groupBy("machine_key").count())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "Bucketed: true" not in text
    assert re.search(r"hashpartitioning\(machine_key#\d+L?, time_key#\d+L?, 13\)", text), text


def test_latest_status_has_no_sort_aggregate(star):
    assert "SortAggregate" not in plan_text(A.latest_status(star))


def test_ranking_has_no_window_over_all_machines(star):
    text = plan_text(A.productivity_ranking(star))
    for line in text.splitlines():
        if "Window [rank(" in line:
            assert re.search(r"_range_\w+#", line.split("AS ", 1)[1]), line  # partitioned by range


def test_filters_reach_the_scan(star):
    text = plan_text(A.alerts(star))
    assert "PushedFilters: [Or(GreaterThan(temperature_c,85.0),GreaterThan(vibration_hz,4.5))" in text
    text = plan_text(A.least_energy_efficient(star))
    assert "EqualTo(operation_mode,Active)" in text


def test_column_pruning(star):
    text = plan_text(A.energy_by_mode(star))
    assert "ReadSchema: struct<power_kw:double,operation_mode:string>" in text


def test_deviant_machines_scans_production_once(spark, star):
    df = A.deviant_machines(star)
    text = plan_text(df, final=True).split("== Initial Plan ==")[0]
    # the fleet-means branch reuses the per-machine shuffle of the first branch
    assert "ReusedExchange" in text
    assert len(re.findall(r"FileScan parquet \S*production_fact\[", text)) == 1


def test_kpi_trend_prunes_to_newest_partitions(spark):
    import uuid

    from plantpulse.operators import fleet as K
    from plantpulse.operators.clean import as_converted
    from plantpulse.plans.config import checkpoint_root
    from plantpulse.sources.fixture import sensor_readings
    from plantpulse.sources.warehouse import Warehouse

    wh = Warehouse(spark, f"{checkpoint_root(spark)}/plantpulse-tests/{uuid.uuid4().hex}", date_grain="day")
    wh.load(as_converted(sensor_readings(spark, SF_SMALL)), with_rejects=False)
    pruned = K.kpi_trend(wh)
    assert sorted(pruned.collect()) == sorted(K.kpi_trend(wh.star()).collect())
    from plantpulse.plans.inspect import plan_formatted

    text = plan_formatted(pruned)
    last = wh.latest_date()
    since = (last - __import__("datetime").timedelta(days=2)).isoformat()
    filters = re.findall(r"PartitionFilters: \[[^\n]*\]", text)
    assert filters and all(f"reading_date#" in f and f">= {since}" in f for f in filters
                           if "reading_date" in f), filters
    # the two window scans, both pruned, with the window itself as a literal in the scan
    assert sum("reading_date" in f for f in filters) == 2
    assert len(re.findall(r"GreaterThan\(time_key,\d+\)", text)) == 2
    for hours in (48, 200):  # the pruning follows the hours
        assert sorted(K.kpi_trend(wh, hours).collect()) == sorted(K.kpi_trend(wh.star(), hours).collect())


def test_dashboard_range_prunes_date_partitions(spark):
    import datetime as dt
    import uuid

    from plantpulse.operators import charts
    from plantpulse.operators.clean import as_converted
    from plantpulse.plans.config import checkpoint_root
    from plantpulse.plans.inspect import plan_formatted
    from plantpulse.sources.fixture import sensor_readings
    from plantpulse.sources.warehouse import Warehouse

    wh = Warehouse(spark, f"{checkpoint_root(spark)}/plantpulse-tests/{uuid.uuid4().hex}", date_grain="day")
    flat = sensor_readings(spark, SF_SMALL)
    wh.load(as_converted(flat), with_rejects=False)
    kw = {"start": "2024-01-08", "end": "2024-01-21", "hours": (8, 17)}
    df = charts.filter_readings(A.readings_view(wh.star_between(dt.date(2024, 1, 8), dt.date(2024, 1, 21))), **kw)
    expect = charts.filter_readings(flat, **kw).drop("reading_id")
    assert sorted(df.collect()) == sorted(expect.select(*df.columns).collect())
    filters = re.findall(r"PartitionFilters: \[[^\n]*\]", plan_formatted(df))
    dated = [f for f in filters if "reading_date" in f]  # the fact scan, of both facts side by side
    assert len(dated) == 1 and all(">= 2024-01-08" in f and "<= 2024-01-21" in f for f in dated)
