"""Star schema: machine and time dimensions, production and quality facts.

Everything is a set operation; no cursor, no driver-side dictionary:

* machine keys: ``max(existing) + position among new ids`` -- assigned in
  bounded blocks (see :func:`dense_keys`), never in one task;
* time key: microseconds since the epoch, computed per row (no lookup);
* insert-if-absent: ``left_anti`` joins on the natural / surrogate key;
* re-load protection: duplicates within a load collapse to one row per
  (machine_key, time_key) -- the smallest reading id wins -- and rows already
  in the fact are skipped, so loading the same input twice adds nothing.

All functions are lazy and return only the *new* rows of a table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantpulse.functions.columns import time_key_of, ts_of_time_key
from plantpulse.operators.clean import good_rows
from plantpulse.schema import (
    CATEGORIES, MACHINE_DIM, PRODUCTION_FACT, PRODUCTION_MEASURES, QUALITY_FACT,
    QUALITY_MEASURES, TIME_DIM, WIDE_FACT,
)

_BLOCK_BITS = 16  # dense-key blocks hold at most 2**16 ids; there are at most 2**16 blocks


class Star(NamedTuple):
    machine_dim: DataFrame
    time_dim: DataFrame
    production: DataFrame
    quality: DataFrame
    #: Both facts on one grain, where a warehouse keeps them so; else they are joined when asked for.
    wide: DataFrame | None = None


def empty_star(spark: SparkSession) -> Star:
    e = spark.createDataFrame
    return Star(e([], MACHINE_DIM), e([], TIME_DIM), e([], PRODUCTION_FACT), e([], QUALITY_FACT))


def dense_keys(ids: DataFrame, id_col: str, key_col: str, start: DataFrame) -> DataFrame:
    """Number distinct integer ids 1, 2, ... in ascending order, plus ``start``.

    A global ``row_number()`` would pull every id into one task.  Instead ids
    are grouped into blocks of 2**16 consecutive values: positions are numbered
    inside each block (a group of at most 65,536 rows), and each block's offset
    is a running sum over per-block counts (at most 65,536 rows, broadcast).
    ``start`` is a one-row frame with column ``start``.
    """
    blk = F.shiftright(F.col(id_col), _BLOCK_BITS).alias("_blk")
    ids = ids.select(F.col(id_col), blk)
    pos = ids.withColumn("_pos", F.row_number().over(Window.partitionBy("_blk").orderBy(id_col)))
    offsets = (ids.groupBy("_blk").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(
                   Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .drop("_n"))
    return (pos.join(F.broadcast(offsets), "_blk")
            .crossJoin(F.broadcast(start))
            .select((F.col("start") + F.col("_off") + F.col("_pos")).cast("int").alias(key_col),
                    F.col(id_col)))


def new_machine_rows(keyed: DataFrame, machine_dim: DataFrame) -> DataFrame:
    """Machine ids not yet in the dimension, with fresh keys."""
    new_ids = (keyed.select("machine_id").where(F.col("machine_id").isNotNull()).distinct()
               .join(machine_dim.select("machine_id"), "machine_id", "left_anti"))
    start = machine_dim.agg(F.coalesce(F.max("machine_key"), F.lit(0)).cast("long").alias("start"))
    return (dense_keys(new_ids, "machine_id", "machine_key", start)
            .withColumn("load_ts", F.current_timestamp())
            .select(*MACHINE_DIM.fieldNames()))


def new_time_rows(keyed: DataFrame, time_dim: DataFrame) -> DataFrame:
    """Timestamps not yet in the dimension, with hour and minute."""
    keys = (keyed.where(F.col("reading_ts").isNotNull())
            .select(time_key_of("reading_ts").alias("time_key")).distinct()
            .join(time_dim.select("time_key"), "time_key", "left_anti"))
    ts = ts_of_time_key("time_key")
    return keys.select("time_key", ts.alias("reading_ts"), F.hour(ts).alias("hour"),
                       F.minute(ts).alias("minute"), F.current_timestamp().alias("load_ts"))


def _new_fact_rows(good: DataFrame, machine_dim: DataFrame, fact: DataFrame,
                   measures: list[str], columns: list[str]) -> DataFrame:
    rows = (good.join(machine_dim.select("machine_id", "machine_key"), "machine_id")  # no key -> skipped
            .withColumn("time_key", time_key_of("reading_ts")))
    # One row per (machine, time): smallest reading id, then a hash of the values
    # as a deterministic tie-break.  `rn = 1` is planned as a group limit that
    # also runs before the shuffle.
    w = Window.partitionBy("machine_key", "time_key").orderBy(
        "reading_id", F.xxhash64(*measures, *[c for c in CATEGORIES if c in columns]))
    dedup = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    fresh = dedup.join(fact.select("machine_key", "time_key"), ["machine_key", "time_key"], "left_anti")
    return fresh.withColumn("load_ts", F.current_timestamp()).select(*columns)


def new_production_rows(converted: DataFrame, machine_dim: DataFrame, production: DataFrame) -> DataFrame:
    return _new_fact_rows(good_rows(converted, "production"), machine_dim, production,
                          PRODUCTION_MEASURES, PRODUCTION_FACT.fieldNames())


def new_quality_rows(converted: DataFrame, machine_dim: DataFrame, quality: DataFrame) -> DataFrame:
    return _new_fact_rows(good_rows(converted, "quality"), machine_dim, quality,
                          QUALITY_MEASURES, QUALITY_FACT.fieldNames())


def build_star(converted: DataFrame, existing: Star) -> Star:
    """New rows of all four tables for one load (lazy).

    Dimensions take every row whose two keys parse, even if a measure is bad;
    facts take the rows good for that fact.  Facts look machine keys up in the
    dimension *after* this load's new machines are added.
    """
    keyed = good_rows(converted, "keys")
    machines = new_machine_rows(keyed, existing.machine_dim)
    times = new_time_rows(keyed, existing.time_dim)
    all_machines = existing.machine_dim.unionByName(machines)
    return Star(
        machines, times,
        new_production_rows(converted, all_machines, existing.production),
        new_quality_rows(converted, all_machines, existing.quality),
    )


def new_wide_rows(new_production: DataFrame, old_production: DataFrame, new_quality: DataFrame, old_quality: DataFrame) -> DataFrame:
    """Readings that a load completes: in both facts now, but not before.  A reading whose halves come with
    different loads is completed by the later one."""
    keys = ["machine_key", "time_key"]
    bare = lambda df: df.drop("load_ts")
    pairs = bare(new_production).join(bare(new_quality).unionByName(bare(old_quality)), keys) \
        .unionByName(bare(old_production).join(bare(new_quality), keys))
    return pairs.withColumn("load_ts", F.current_timestamp()).select(*WIDE_FACT.fieldNames())


def union_star(a: Star, b: Star) -> Star:
    return Star(*[x.unionByName(y) for x, y in zip(a[:4], b[:4], strict=True)])
