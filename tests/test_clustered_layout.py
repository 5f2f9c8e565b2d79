"""Facts lie in machine order inside a date's files: a filter on one machine skips row groups."""

from __future__ import annotations

import datetime as dt
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plantpulse.operators import analytics as A, charts
from plantpulse.operators.clean import as_converted
from plantpulse.plans.config import checkpoint_root
from plantpulse.schema import MEASURES
from plantpulse.sources.warehouse import Warehouse

N, MACHINES, DAYS = 24_000, 60, 3


@pytest.fixture(scope="module")
def warehouse(spark):
    i = F.col("id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    readings = spark.range(N).select(
        i.alias("reading_id"), (F.hash("id") % MACHINES + MACHINES).cast("int").alias("machine_id"),
        F.timestamp_add("SECOND", (i % (DAYS * 2400)) * 36, start).alias("reading_ts"), F.lit("Active").alias("operation_mode"),
        F.lit("Low").alias("efficiency_status"), *[(i % 97).cast("double").alias(m) for m in MEASURES])
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    old = hadoop.get("parquet.block.size")
    hadoop.set("parquet.block.size", str(32 * 1024))  # several row groups in small files
    try:
        wh = Warehouse(spark, f"{checkpoint_root(spark)}/plantpulse-tests/{uuid.uuid4().hex}")
        wh.load(as_converted(readings))
    finally:
        hadoop.unset("parquet.block.size") if old is None else hadoop.set("parquet.block.size", old)
    return wh


def scanned_rows(df):
    df.collect()

    def scans(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return scans(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return scans(node.plan())
        own = [node.metrics().apply("numOutputRows").value()] if name == "FileSourceScanExec" and "_fact" in node.toString() else []
        kids = node.children()
        return own + [x for k in range(kids.size()) for x in scans(kids.apply(k))]

    return sum(scans(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize("table", ["production_fact", "quality_fact", "wide_fact"])
def test_files_are_sorted_and_can_rule_machines_out(spark, warehouse, table):
    groups = 0
    for path in warehouse.table(table).inputFiles():
        f = pq.ParquetFile(path.removeprefix("file://"))
        t = f.read(columns=["machine_key", "time_key"])
        pairs = list(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))
        assert pairs == sorted(pairs)
        groups += f.num_row_groups
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
            jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf))
        first = [b.getColumns().get(0) for b in reader.getFooter().getBlocks()]  # a chunk with a dictionary needs no bloom filter
        assert all(c.getBloomFilterOffset() > 0 or c.hasDictionaryPage() for c in first)
        reader.close()
    assert groups > len(warehouse.table(table).inputFiles())


def test_one_machine_reads_few_rows(warehouse):
    df = charts.filter_warehouse(warehouse, start="2024-01-02", end="2024-01-02", machine=70)
    want = charts.filter_readings(A.readings_view(warehouse.star()), start="2024-01-02", end="2024-01-02", machine=70)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect())) and df.count() > 0
    assert scanned_rows(df) < 0.3 * N / DAYS
    assert scanned_rows(charts.filter_warehouse(warehouse, machine=70)) < 0.3 * N
    assert charts.filter_warehouse(warehouse, machine=12345).count() == 0
    assert charts.filter_warehouse(warehouse, end="2024-01-01", hours=(3, 4)).agg(F.max("reading_ts")).first()[0] < dt.datetime(2024, 1, 1, 5)
