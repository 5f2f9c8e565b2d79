"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plantpulse.plans.config import checkpoint_root

#: Separators of words: space and the ASCII control characters from tab to carriage return.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"
#: A side is broadcast only when its counted rows stay under this.
BROADCAST_ROWS = 1_000_000
#: Rows with whole texts that go to a Python worker at once.
TEXT_ROWS = 1_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application
    (a zip through ``addPyFile``; needless but harmless where it is installed)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="plantpulse-ship-"), "plantpulse_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def write_shared(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """Write a frame to the cluster's shared folder and read it back.

    Cuts the lineage with files that outlive any executor.  With ``texts``, Python workers get
    ``TEXT_ROWS`` rows at once at most: both sides of the pipe hold a batch several times.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/corpus/{uuid.uuid4().hex}-{name}"
    rows = spark.conf.get(BATCH_ROWS)
    smaller = texts and not 0 < int(rows) <= TEXT_ROWS
    if smaller:
        spark.conf.set(BATCH_ROWS, str(TEXT_ROWS))
    try:
        df.write.parquet(path)
    finally:
        if smaller:
            spark.conf.set(BATCH_ROWS, rows)
    return spark.read.schema(df.schema).parquet(path)


def lean(run):
    """``run`` for ``mapInArrow``.  When a task ends, free memory goes back to the system: workers stay alive
    beside the tasks that follow, and their allocators keep what the largest batch took."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return whole


def drop_shared(*frames: DataFrame) -> None:
    """Delete tables of :func:`write_shared` that nothing reads any more (what was made of them is written)."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.split(":", 1)[-1].lstrip("/").startswith(f"{checkpoint_root(spark)}/corpus/".split(":", 1)[-1].lstrip("/")):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps whose results are written: it does so when the driver's
    plans are collected, which without this may take until the next full collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint when its counted ``rows`` allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null, empty and blank texts."""
    return F.coalesce(F.array_remove(F.split(text, WORD_SEPARATORS), ""), F.array().cast("array<string>"))


def with_text(kept: DataFrame, docs: DataFrame, text: str):
    """``kept`` with the bytes of ``docs``' text as seen by Python workers, and how to take them from a batch.

    A text column that is kept anyway goes to the workers once; any other is added as ``__t``.
    """
    if text in kept.columns and isinstance(kept.schema[text].dataType, T.StringType):
        at = kept.columns.index(text)
        return kept, lambda batch: batch.column(at).fill_null("").cast("binary")
    whole = kept.withColumn("__t", F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary"))
    return whole, lambda batch: batch.column(batch.num_columns - 1)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Binding through a lambda keeps the optimizer from copying ``value`` into
    every place (and every loop turn) that uses it.
    """
    return F.transform(F.array(value), body)[0]


def group_by_bytes(sizes, limit: int = 8 << 20):
    """Row ranges ``(lo, hi)`` whose sizes sum to at most ``limit`` (one row at least)."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)
