"""Spark session settings and the shared scratch root.

Scale notes
-----------
* AQE re-plans at every shuffle: it coalesces small partitions, splits skewed
  join partitions and turns a sort-merge join into a broadcast join when a side
  turns out small *at run time* (a measured, not a guessed, size).
* ``spark.sql.shuffle.partitions`` is the initial partition count; on a large
  cluster set it to roughly (shuffle bytes / 128 MB) and let AQE coalesce.
* Intermediate tables are written under ``spark.checkpoint.dir`` (a shared
  folder on a cluster).  We only pick our own folder when it is unset (tests,
  local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def scale_conf(shuffle_partitions: int = 8) -> dict[str, str]:
    return {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # coalesce shuffle output to the advisory size (64 MB) rather than keeping
        # one partition per core: fewer, fuller tasks on a busy cluster
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.localShuffleReader.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.bucketing.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "plantpulse", extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above.  Local use only:
    on a cluster the session comes from the platform and keeps its own conf."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**scale_conf(shuffle_partitions), **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", os.environ.get("PLANTPULSE_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN_ROOT: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (or the context's
    checkpoint dir).  Only when neither is set *and* Spark runs in local mode
    (tests, a laptop) a fresh local folder is chosen -- once per application,
    so every caller gets the same root -- and given to the context for
    ``DataFrame.checkpoint()``.  On a cluster an unset folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            _OWN_ROOT[app] = jdir.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                # a folder on the driver's disk is invisible to executors
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                                   "(HDFS / object store); it is where warehouses and checkpoints go")
            own = tempfile.mkdtemp(prefix="plantpulse-ckpt-")
            spark.sparkContext.setCheckpointDir(own)
            _OWN_ROOT[app] = own
    return _OWN_ROOT[app].rstrip("/")
