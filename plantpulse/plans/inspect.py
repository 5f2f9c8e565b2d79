"""Plan inspection: used by tests to pin the physical shape of each query."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, final: bool = False) -> str:
    """Physical plan as text.  ``final=True`` runs this very query first
    (``collect``: meant for the small results of tests and notebooks) so the
    adaptive plan shows what actually executed, e.g. reused exchanges."""
    if final:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def plan_formatted(df: DataFrame) -> str:
    """The text of ``df.explain("formatted")``: every scan with its full
    PushedFilters / PartitionFilters / ReadSchema."""
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def count_operator(df: DataFrame, name: str) -> int:
    return plan_text(df).count(name)


def assert_no_python_udf(df: DataFrame) -> None:
    text = plan_text(df)
    for op in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas"):
        if op in text:
            raise AssertionError(f"plan contains {op}:\n{text}")
