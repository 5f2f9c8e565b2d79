"""The persisted star: Parquet tables partitioned by load and reading date, with load-level commits.

Layout under ``root``::

    machine_dim/load_id=<n>/...                       tiny; broadcast by the planner on real file size
    time_dim/load_id=<n>/reading_date=<d>/...
    production_fact/load_id=<n>/reading_date=<d>/...
    quality_fact/load_id=<n>/reading_date=<d>/...
    wide_fact/load_id=<n>/reading_date=<d>/...        both facts side by side, for readings that are in both
    production_rollup/load_id=<n>/...                 mergeable sums per machine, hour, mode and status ...
    paired_rollup/load_id=<n>/...                     ... of the production fact and of the wide fact
    rejects/load_id=<n>/...                           dead-letter rows of each load
    _layout/                                          the date grain, written once with the first table
    _loads/                                           commit log: one row per committed load

Why this shape at scale
-----------------------
* The layout is stored with the data: whoever opens the warehouse reads the
  grain it was written with, and asking for another one is an error.
* Production and quality are joined once, by the load that brings them (its rows and those
  of its dates only), on both grain keys: the pair is hashed, so a machine that holds a third of
  all rows is spread over all tasks.  Queries on both facts read the wide fact, with no join.
* Rollups are sums that merge: a load adds the rows of what it adds, nothing is rewritten.
* Writes are rebalanced by reading date: large dates are split over several
  files, small ones share a task.
* Each load only *appends* a ``load_id`` partition to every table; nothing is
  rewritten.  A load becomes visible when its id is appended to ``_loads``,
  which happens last.  Readers prune to live ids, so a load that died half-way
  (lost executors, a killed driver) is invisible, and re-running it is safe
  because the loader skips what live loads already hold.
* An incremental load checks "already loaded?" only against the existing
  partitions of the dates present in its batch (a semi-join on the partition
  column, which the planner may turn into dynamic partition pruning).
* Single writer per warehouse (no concurrent loads).
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantpulse.functions.columns import ts_of_time_key
from plantpulse.operators.clean import rejects as reject_rows
from plantpulse.operators.rollups import Rollups, paired_rollup, production_rollup, tasks_for
from plantpulse.operators.star import (
    Star, new_machine_rows, new_production_rows, new_quality_rows, new_time_rows, new_wide_rows,
)
from plantpulse.schema import REJECTS, STAR_SCHEMAS

STAR_TABLES = ("machine_dim", "time_dim", "production_fact", "quality_fact", "wide_fact")
TABLES = (*STAR_TABLES, "production_rollup", "paired_rollup", "rejects")
_DATED = ("time_dim", "production_fact", "quality_fact", "wide_fact")
#: Facts lie in order of machine and time inside a date's files, with a bloom filter on the machine per row group, so
#: that a filter on one machine skips the row groups of the others.
_CLUSTERED = ("production_fact", "quality_fact", "wide_fact")
#: Distinct machines that a row group's bloom filter is sized for.
MACHINES_A_FILE = 10_000
_LOG_SCHEMA = T.StructType([
    T.StructField("load_id", T.LongType(), False),
    T.StructField("committed_at", T.TimestampType(), False),
    T.StructField("batch_key", T.StringType(), True),
])


def _schema(table: str) -> T.StructType:
    return REJECTS if table == "rejects" else STAR_SCHEMAS[table]


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _exists(spark: SparkSession, path: str) -> bool:
    """Existence check on the cluster file system (HDFS, object store, local)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def date_partition(ts: F.Column, grain: str) -> F.Column:
    """Partition value of a timestamp: its day, or the first day of its month."""
    if grain == "day":
        return F.to_date(ts)
    if grain == "month":
        return F.to_date(F.date_trunc("month", ts))
    raise ValueError("grain must be 'day' or 'month'")


@dataclass
class Warehouse:
    """``date_grain``: 'day' or 'month'; pick the grain that keeps a date
    partition of a fact well above ~1 GB.  It counts when the warehouse is created
    ('day' unless given) and is read from the warehouse afterwards."""

    spark: SparkSession
    root: str
    date_grain: str | None = None

    def __post_init__(self) -> None:
        self.root = self.root.rstrip("/")
        self.prefix = "pp_" + hashlib.sha1(self.root.encode()).hexdigest()[:12]
        self._ensured = False
        self._recover = False
        self._ids: list[int] | None = None
        self._keys: set[str] = set()
        self._star: Star | None = None
        self._rollups: Rollups | None = None
        self._latest = None

    # -- catalog ---------------------------------------------------------
    def name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _partitions(self, table: str) -> list[str]:
        return ["load_id", "reading_date"] if table in _DATED else ["load_id"]

    def _settle_layout(self) -> None:
        """Read the stored grain, or store the one of a new warehouse."""
        path = f"{self.root}/_layout"
        if _exists(self.spark, path):
            stored = self.spark.read.schema("date_grain string").parquet(path).first()[0]
            if self.date_grain not in (None, stored):
                raise ValueError(f"{self.root} is partitioned by {stored}, not by {self.date_grain}")
            self.date_grain = stored
        else:
            self.date_grain = self.date_grain or "day"
            date_partition(F.lit(None), self.date_grain)  # a wrong grain raises before anything is written
            self.spark.createDataFrame([(self.date_grain,)], "date_grain string").coalesce(1).write.parquet(path)

    def ensure_tables(self) -> None:
        """Create the tables if absent (CREATE TABLE IF NOT EXISTS over a
        fixed location); a new catalog entry picks up the partitions already
        on disk.  Appends through this class register their partitions."""
        if self._ensured:
            return
        self._settle_layout()
        for t in TABLES:
            if self.spark.catalog.tableExists(self.name(t)):
                # a catalog entry tracks the partitions appended through it; pick
                # up other applications' appends only when a refresh asked for it
                if self._recover and _exists(self.spark, self.path(t)):
                    self.spark.sql(f"ALTER TABLE {self.name(t)} RECOVER PARTITIONS")
                continue
            extra = ", load_id BIGINT" + (", reading_date DATE" if t in _DATED else "")
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.name(t)} ({_ddl(_schema(t))}{extra}) "
                f"USING parquet PARTITIONED BY ({', '.join(self._partitions(t))}) "
                f"LOCATION '{self.path(t)}'")
            # partitions written by other sessions / applications: one listing
            # when the catalog entry is new, never again afterwards
            if _exists(self.spark, self.path(t)):
                self.spark.sql(f"ALTER TABLE {self.name(t)} RECOVER PARTITIONS")
        self._ensured = True
        self._recover = False

    # -- commit log ------------------------------------------------------
    def log(self) -> DataFrame:
        return self.spark.read.schema(_LOG_SCHEMA).parquet(f"{self.root}/_loads")

    def committed_ids(self) -> list[int]:
        """Ids of the committed loads.  The log holds one row per load (not per
        record); it is read once and kept, and :meth:`refresh` re-reads it
        after another writer's load."""
        if self._ids is None:
            if not _exists(self.spark, f"{self.root}/_loads"):
                return []
            rows = self.log().collect()
            self._ids = sorted(r["load_id"] for r in rows)
            self._keys = {r["batch_key"] for r in rows if r["batch_key"] is not None}
        return list(self._ids)

    def has_batch(self, batch_key: str) -> bool:
        self.committed_ids()
        return batch_key in self._keys

    def refresh(self) -> None:
        """Forget cached state: the next read re-reads the commit log and
        registers partitions other applications appended."""
        self._ids = None
        self._star = None
        self._rollups = None
        self._latest = None
        self._ensured = False
        self._recover = True

    def _commit(self, load_id: int, batch_key: str | None) -> None:
        (self.spark.createDataFrame([(load_id, batch_key)], "load_id bigint, batch_key string")
         .select("load_id", F.current_timestamp().alias("committed_at"), "batch_key")
         .coalesce(1).write.mode("append").parquet(f"{self.root}/_loads"))
        self._ids = None
        self._star = None
        self._rollups = None
        self._latest = None

    # -- read ------------------------------------------------------------
    def table(self, table: str, ids: list[int] | None = None, keep_partition_cols: bool = False,
              keep_load_id: bool = False) -> DataFrame:
        self.ensure_tables()
        ids = self.committed_ids() if ids is None else ids
        df = self.spark.table(self.name(table)).where(F.col("load_id").isin(ids or [-1]))
        if not keep_partition_cols:
            df = df.drop(*[c for c in self._partitions(table) if not (keep_load_id and c == "load_id")])
        return df

    def star(self, ids: list[int] | None = None) -> Star:
        """The four tables over the live loads (or the given ids).  The live
        view is built once and kept until the next commit: DataFrames are
        immutable plans, so queries can share them."""
        if ids is not None:
            return Star(*[self.table(t, ids) for t in STAR_TABLES])
        if self._star is None:
            live = self.committed_ids()
            self._star = Star(*[self.table(t, live) for t in STAR_TABLES])
        return self._star

    def rollups(self) -> Rollups:
        """The rollups of all live loads, not yet merged, and the machine dimension."""
        if self._rollups is None:
            self._rollups = Rollups(*[self.table(t) for t in ("machine_dim", "production_rollup", "paired_rollup")])
        return self._rollups

    def rejects(self) -> DataFrame:
        return self.table("rejects")

    def latest_date(self):
        """Newest reading-date partition among live loads, from the catalog's
        partition list (metadata; bounded by the number of partitions)."""
        import datetime as dt

        if self._latest is not None:
            return self._latest
        self.ensure_tables()
        live = set(self.committed_ids())
        best = None
        for row in self.spark.sql(f"SHOW PARTITIONS {self.name('production_fact')}").collect():
            parts = dict(kv.split("=", 1) for kv in row[0].split("/"))
            if int(parts["load_id"]) in live:
                d = dt.date.fromisoformat(parts["reading_date"])
                best = d if best is None or d > best else best
        self._latest = best
        return best

    def star_since(self, first_day) -> Star:
        """The live star with the time dimension and facts pruned to date
        partitions on or after ``first_day`` (partition pruning at the scan)."""
        return self.star_between(first_day, None)

    def star_between(self, first_day, last_day=None) -> Star:
        """The live star pruned to date partitions that can hold readings from
        ``first_day`` through ``last_day`` (inclusive; None = open end).  The
        bounds are literals on the partition column, so the scans skip every
        other partition; callers still filter exact timestamps."""
        import datetime as dt

        self.ensure_tables()
        self.committed_ids()
        if self.date_grain == "month":
            first_day = first_day.replace(day=1)
        cond = F.col("reading_date") >= F.lit(dt.date.isoformat(first_day)).cast("date")
        if last_day is not None:
            cond = cond & (F.col("reading_date") <= F.lit(dt.date.isoformat(last_day)).cast("date"))

        def pruned(t: str) -> DataFrame:
            return self.table(t, keep_partition_cols=True).where(cond).drop("load_id", "reading_date")

        return Star(self.table("machine_dim"), *[pruned(t) for t in STAR_TABLES[1:]])

    def on_days(self, table: str, days: list) -> DataFrame:
        """Rows of a dated table in the partitions of the given days (literals on the partition column)."""
        first = sorted({(d.replace(day=1) if self.date_grain == "month" else d).isoformat() for d in days})
        df = self.table(table, keep_partition_cols=True)
        return df.where(F.col("reading_date").isin([F.lit(d).cast("date") for d in first]) if first else F.lit(False)) \
            .drop("load_id", "reading_date")

    def machine_key(self, machine_id: int) -> int | None:
        """The key of a machine, looked up in the dimension (one row), to be used as a literal on the facts."""
        row = self.table("machine_dim").where(F.col("machine_id") == F.lit(machine_id)).select("machine_key").first()
        return None if row is None else row["machine_key"]

    def _on_dates(self, table: str, ids: list[int], dates: DataFrame) -> DataFrame:
        """Rows of ``table`` on the given reading dates only: a semi-join on the
        partition column, which the planner broadcasts and prunes with when the
        batch's distinct dates are few (their measured size decides)."""
        return (self.table(table, ids, keep_partition_cols=True)
                .join(dates, "reading_date", "left_semi")
                .drop("load_id", "reading_date"))

    # -- write -----------------------------------------------------------
    def _append(self, table: str, df: DataFrame, load_id: int) -> None:
        out = df.select(*_schema(table).fieldNames()).withColumn("load_id", F.lit(load_id).cast("bigint"))
        options = {}
        if table in _DATED:
            out = out.withColumn("reading_date", date_partition(ts_of_time_key("time_key"), self.date_grain))
            # rows of one date meet in few tasks (few files), yet a large date is split
            out = out.hint("rebalance", "reading_date")
        if table in _CLUSTERED:
            out = out.sortWithinPartitions("load_id", "reading_date", "machine_key", "time_key")
            options = {"parquet.bloom.filter.enabled#machine_key": "true", "parquet.bloom.filter.expected.ndv#machine_key": str(MACHINES_A_FILE)}
        (out.write.mode("append").format("parquet").partitionBy(*self._partitions(table)).options(**options)
         .option("path", self.path(table)).saveAsTable(self.name(table)))

    def load(self, converted: DataFrame, with_rejects: bool = True, batch_key: str | None = None) -> int | None:
        """Load one batch of converted readings; returns the committed load id.

        Order: dimensions, then facts (which look up machine keys in the live
        dimension plus this load's new machines), then rejects, then the
        commit record.  Each step is a Spark write of set operations; the
        driver handles only table names and load ids.

        ``batch_key`` names the input batch (e.g. a stream epoch): a batch whose
        key is already committed is skipped, so replaying it after a failure
        cannot load its rejects twice (facts and dimensions are idempotent
        anyway).  Returns None when skipped.
        """
        self.ensure_tables()
        if batch_key is not None and self.has_batch(batch_key):
            return None
        ids = self.committed_ids()
        load_id = int(time.time() * 1_000_000)
        # Convert once: the typed batch is written to the shared folder and
        # every step below reads it back (typed, columnar, pruned) instead of
        # re-reading and re-casting the raw strings five times.  It also pins
        # the input of this load (and cuts its lineage).
        batch_path = f"{self.root}/_batches/load_id={load_id}"
        converted.write.mode("overwrite").parquet(batch_path)
        converted = self.spark.read.schema(converted.schema).parquet(batch_path)
        keyed = converted.where(F.col("key_reason").isNull())
        dates = keyed.select(date_partition(F.col("reading_ts"), self.date_grain).alias("reading_date")).distinct()
        machines_now = self.table("machine_dim", ids)
        self._append("machine_dim", new_machine_rows(keyed, machines_now), load_id)
        self._append("time_dim", new_time_rows(keyed, self._on_dates("time_dim", ids, dates)), load_id)
        machines = self.table("machine_dim", ids + [load_id])
        self._append("production_fact", new_production_rows(
            converted, machines, self._on_dates("production_fact", ids, dates)), load_id)
        self._append("quality_fact", new_quality_rows(
            converted, machines, self._on_dates("quality_fact", ids, dates)), load_id)
        old_facts = [self._on_dates(t, ids, dates) for t in ("production_fact", "quality_fact")]
        new_facts = [self.table(t, [load_id]) for t in ("production_fact", "quality_fact")]
        self._append("wide_fact", new_wide_rows(new_facts[0], old_facts[0], new_facts[1], old_facts[1]), load_id)
        tasks = tasks_for(converted.count())
        self._append("production_rollup", production_rollup(new_facts[0], tasks), load_id)
        self._append("paired_rollup", paired_rollup(self.table("wide_fact", [load_id]), tasks), load_id)
        if with_rejects:
            self._append("rejects", reject_rows(converted), load_id)
        self._commit(load_id, batch_key)
        _delete(self.spark, batch_path)
        return load_id
