from __future__ import annotations

from plantpulse.functions.display import fmt_n2, fmt_pct, fmt_plain2, fmt_py2


def test_formatting_cases(spark):
    df = spark.createDataFrame([(0.125,), (1.005,), (1234567.875,), (1234.5,), (-0.001,), (None,)], "x double")
    rows = df.select(fmt_py2("x").alias("py"), fmt_n2("x").alias("n2"), fmt_plain2("x").alias("p"),
                     fmt_pct("x").alias("pct")).collect()
    assert [r["py"] for r in rows] == ["0.12", "1.00", "1,234,567.88", "1,234.50", "-0.00", None]
    assert [r["n2"] for r in rows][:2] == ["0.13", "1.01"]
    assert rows[3]["p"] == "1234.50"
    assert rows[0]["pct"] == "0.13%" and rows[5]["pct"] is None
