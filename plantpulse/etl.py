"""End-to-end load: source -> (staging) -> cleaned -> star, as one Spark job chain.

    spark-submit plantpulse/etl.py --source s3a://.../readings/*.csv \\
        --warehouse s3a://.../plantpulse --staging s3a://.../staging

Re-running it with the same input adds nothing (the loader skips what is
already in the star); ``--batch-key`` makes a replay skip even the rejects.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession, types as T

if __name__ == "__main__":  # started as a script: the package is one folder up
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plantpulse.operators.clean import convert  # noqa: E402
from plantpulse.plans.config import scale_conf  # noqa: E402
from plantpulse.schema import RAW, SOURCE_NOTES  # noqa: E402
from plantpulse.sources.files import land_raw, read_csv  # noqa: E402
from plantpulse.sources.warehouse import Warehouse  # noqa: E402


def run_etl(spark: SparkSession, source: str, warehouse: str, staging: str | None = None,
            source_format: str = "csv", date_grain: str | None = None,
            batch_key: str | None = None) -> int | None:
    """Load one source batch; returns the committed load id (None if a batch of
    this key is loaded already; nothing is staged then).  An empty source raises."""
    wh = Warehouse(spark, warehouse, date_grain=date_grain)
    if batch_key is not None and wh.has_batch(batch_key):
        return None
    if source_format == "csv":
        raw = read_csv(spark, source)
    elif source_format == "parquet":
        raw = spark.read.schema(T.StructType([*RAW.fields, *SOURCE_NOTES])).parquet(source)
    else:
        raise ValueError("source_format must be 'csv' or 'parquet'")
    if raw.isEmpty():
        raise ValueError(f"no records in {source}")
    if staging:
        land_raw(raw, staging)
    return wh.load(convert(raw), batch_key=batch_key)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description="Load sensor readings into the star.")
    ap.add_argument("--source", required=True)
    ap.add_argument("--warehouse", required=True)
    ap.add_argument("--staging")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--date-grain", choices=["day", "month"])
    ap.add_argument("--batch-key")
    a = ap.parse_args(argv)
    builder = SparkSession.builder.appName("plantpulse-etl")
    width = os.environ.get("PLANTPULSE_SHUFFLE_PARTITIONS")
    conf = scale_conf(int(width) if width else 200)
    if not width:
        del conf["spark.sql.shuffle.partitions"]  # the cluster's own setting
    spark = builder.config(map=conf).getOrCreate()
    load_id = run_etl(spark, a.source, a.warehouse, a.staging, a.format, a.date_grain, a.batch_key)
    print(f"committed load {load_id}" if load_id else "batch already loaded")


if __name__ == "__main__":
    main()
