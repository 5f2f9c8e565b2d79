from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF_SMALL
from plantpulse.operators.models import (
    evaluate, label_codes, metrics, score, score_efficiency, score_failure, split_flags, train_efficiency,
)
from plantpulse.plans.inspect import plan_text
from plantpulse.sources.fixture import sensor_readings
from plantpulse.warehouses import trained_models


def test_split_is_about_80_20_and_stable(spark):
    r = sensor_readings(spark, SF_SMALL)
    a = split_flags(r).repartition(1)
    b = split_flags(r).repartition(7)
    assert sorted(a.collect()) == sorted(b.collect())
    share = a.agg(F.avg(F.col("is_test").cast("double"))).first()[0]
    assert 0.15 < share < 0.25


def test_label_codes_alphabetical(spark):
    got = {(r["kind"], r["label"]): r["code"] for r in label_codes(sensor_readings(spark, SF_SMALL)).collect()}
    assert got[("operation_mode", "Active")] == 0 and got[("operation_mode", "Maintenance")] == 2
    assert got[("efficiency_status", "High")] == 0 and got[("efficiency_status", "Medium")] == 2


def test_scores_deterministic_and_bounded(spark):
    eff, fail = trained_models(spark, SF_SMALL)
    rows = sensor_readings(spark, SF_SMALL).limit(200)
    s1 = sorted(score_failure(fail, rows).collect())
    s2 = sorted(score_failure(fail, rows).collect())
    assert s1 == s2
    assert all(0.0 <= r["failure_probability_pct"] <= 100.0 for r in s1)


def test_incomplete_rows_are_answered(spark):
    eff, fail = trained_models(spark, SF_SMALL)
    rows = sensor_readings(spark, SF_SMALL).where("reading_id < 40").withColumn(
        "temperature_c", F.when(F.col("reading_id") < 10, F.lit(float("nan"))).when(F.col("reading_id") < 20, F.lit(None))
        .otherwise(F.col("temperature_c")))
    for out, answer in ((score_efficiency(eff, rows), "predicted_status"), (score_failure(fail, rows), "failure_probability_pct")):
        got = out.collect()
        assert len(got) == 40 and sum(r["status"] == "incomplete" for r in got) == 20
        assert all((r[answer] is None) == (r["status"] == "incomplete") for r in got)


def test_both_scores_come_from_one_scan_and_equal_single_ones(spark):
    eff, fail = trained_models(spark, SF_SMALL)
    rows = sensor_readings(spark, SF_SMALL).withColumn("power_kw", F.when(F.col("reading_id") % 9 > 0, F.col("power_kw")))
    both = score(eff, fail, rows)
    assert plan_text(both).count("FileScan") == 1
    got = {r["reading_id"]: r for r in both.collect()}
    one = {r["reading_id"]: r["predicted_status"] for r in score_efficiency(eff, rows).collect()}
    two = {r["reading_id"]: r["failure_probability_pct"] for r in score_failure(fail, rows).collect()}
    assert {i: r["predicted_status"] for i, r in got.items()} == one and {i: r["failure_probability_pct"] for i, r in got.items()} == two
    assert {r["status"] for r in got.values()} == {"scored", "incomplete"} and len(got) == rows.count()


def test_forests_learn_what_can_be_learned_and_pass_over_missing_labels(spark):
    # a status that follows from two measures, with a tenth of the labels missing
    status = F.when(F.col("speed_uph") > 300, "High").when(F.col("temperature_c") > 70, "Medium").otherwise("Low")
    rows = sensor_readings(spark, SF_SMALL).withColumn("efficiency_status", F.when(F.col("reading_id") % 10 > 0, status))
    eff = train_efficiency(rows)
    assert eff.stages[1].labels == ["High", "Low", "Medium"]
    found = score_efficiency(eff, rows).join(rows.select("reading_id", status.alias("want")), "reading_id")
    assert found.where("want = predicted_status").count() > 0.95 * rows.count()
    other = evaluate(eff, trained_models(spark, SF_SMALL)[1], rows.where(F.col("operation_mode") != "Idle"))  # models of other rows
    value = {r["metric"]: r["value"] for r in other.collect()}
    assert value["accuracy"] > 0.95 and value["f1"] > 0.95 and value["area_under_roc"] > 0.95


def test_metrics_against_duckdb(spark):
    import random

    import duckdb

    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice(["a", "b", "b"]), rnd.randrange(2), rnd.choice([0.0, 0.25, 0.5, 1.0, rnd.random()]))
            for _ in range(3000)]
    schema = "efficiency_status string, predicted_status string, failure_label int, risk double"
    got = {r["metric"]: r["value"] for r in metrics(spark.createDataFrame(rows, schema)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE scored (t VARCHAR, p VARCHAR, y INT, s DOUBLE)")
    con.executemany("INSERT INTO scored VALUES (?, ?, ?, ?)", rows)
    accuracy, f1, auc = con.execute("""
      WITH k AS (SELECT * FROM scored WHERE t IS NOT NULL), c AS (SELECT DISTINCT t FROM k),
      f AS (SELECT c.t, (SELECT count(*) FROM k WHERE k.t = c.t) AS n, (SELECT count(*) FROM k WHERE k.t = c.t AND k.p = c.t) AS hit,
                   (SELECT count(*) FROM k WHERE k.p = c.t) AS called FROM c)
      SELECT (SELECT avg((t = p)::INT) FROM k), (SELECT sum(n * 2.0 * hit / (n + called)) / sum(n) FROM f),
        (SELECT avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) FROM scored a, scored b WHERE a.y = 1 AND b.y = 0)""").fetchone()
    assert abs(got["accuracy"] - accuracy) < 1e-12 and abs(got["f1"] - f1) < 1e-12 and abs(got["area_under_roc"] - auc) < 1e-12
    for part in (rows[:0], [r for r in rows if r[2] == 1]):
        got = {r["metric"]: r["value"] for r in metrics(spark.createDataFrame(part, schema)).collect()}
        assert got["area_under_roc"] is None and (got["accuracy"] is None) == (not part)
