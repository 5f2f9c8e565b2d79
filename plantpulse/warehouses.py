"""Warehouses built from the test data, one per input fingerprint.

``clean_warehouse``  : the star loaded from the clean readings (analyses run here)
``dirty_warehouse``  : raw rows with injected faults, landed to staging, cleaned
                       and loaded with rejects (the ETL path end to end)

Both live under the session's shared checkpoint folder and are built at most
once per input; later calls (and later sessions on the same folder) reuse the
committed tables.  Building is a handful of Spark writes; the driver only
passes paths.
"""

from __future__ import annotations

import hashlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from plantpulse.operators.clean import as_converted, convert
from plantpulse.plans.config import checkpoint_root
from plantpulse.sources.files import land_raw, read_staged
from plantpulse.sources.fixture import dirty_raw, sensor_readings, write_mixed_csv
from plantpulse.sources.warehouse import Warehouse

# Bump when the on-disk layout of the star changes, so old folders are not reused.
LAYOUT_VERSION = 5


def _code_version() -> str:
    """Hash of the modules that decide what a warehouse holds: a code change
    there gives new folders instead of reusing tables built by older code."""
    import os

    import plantpulse
    base = os.path.dirname(plantpulse.__file__)
    h = hashlib.sha1()
    for rel in ("schema.py", "functions/columns.py", "operators/clean.py", "operators/star.py",
                "operators/models.py", "operators/rollups.py", "operators/timestamps.py", "sources/fixture.py", "sources/files.py", "sources/warehouse.py"):
        with open(os.path.join(base, rel), "rb") as f:
            h.update(f.read())
    return h.hexdigest()[:8]


CODE_VERSION = _code_version()

_LOCK = threading.Lock()
_CACHE: dict[tuple[str, str], Warehouse] = {}


def input_fingerprint(spark: SparkSession, sf_dir: str, tables=("events",)) -> str:
    """Hash of every file below the inputs: name, length and time."""
    h = hashlib.sha1()
    for t in tables:
        fs, p = _fs(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")
        found = []
        if fs.exists(p):
            files = fs.listFiles(p, True)
            while files.hasNext():
                st = files.next()
                found.append(f"{st.getPath().toString()}|{st.getLen()}|{st.getModificationTime()}")
        h.update("\n".join([t, *sorted(found)]).encode())
    return h.hexdigest()[:16]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _published(spark: SparkSession, root: str) -> str | None:
    """The folder of the build under ``root`` that was published first."""
    fs, marks = _fs(spark, f"{root}/_published")
    if not fs.exists(marks):
        return None
    found = [(st.getModificationTime(), st.getPath().getName()) for st in fs.listStatus(marks)]
    return f"{root}/{min(found)[1]}" if found else None


def _once(spark: SparkSession, root: str, build) -> str:
    """The folder of a finished build under ``root``; built if there is none.

    Each builder writes into a fresh folder of its own and then publishes it with an empty
    marker named like the folder.  No lock is held, so nothing depends on how long a build takes: two
    builders at a time never share a folder, the earlier marker wins for
    everybody, and a crashed builder leaves only a folder that nobody reads.
    """
    done = _published(spark, root)
    if done is None:
        name = uuid.uuid4().hex
        build(f"{root}/{name}")
        if _published(spark, root) is None:
            fs, mark = _fs(spark, f"{root}/_published/{name}")
            fs.createNewFile(mark)
        done = _published(spark, root)
    return done


def _root(spark: SparkSession, sf_dir: str, kind: str) -> str:
    fp = input_fingerprint(spark, sf_dir)
    return f"{checkpoint_root(spark)}/plantpulse/v{LAYOUT_VERSION}-{CODE_VERSION}/{fp}/{kind}"


# The test inputs are small (at most a few MB per table), so their date
# partitions are monthly; daily ones would hold a few kB each.
TEST_DATE_GRAIN = "month"


def _get(spark: SparkSession, root: str, build, date_grain: str = TEST_DATE_GRAIN) -> Warehouse:
    """The warehouse under ``root``, built once."""
    key = (spark.sparkContext.applicationId, root)
    with _LOCK:
        wh = _CACHE.get(key)
        if wh is None:
            path = _once(spark, root, lambda p: build(Warehouse(spark, p, date_grain=date_grain)))
            wh = _CACHE[key] = Warehouse(spark, path)
    return wh


def clean_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    return _get(spark, _root(spark, sf_dir, "clean"),
                lambda wh: wh.load(as_converted(sensor_readings(spark, sf_dir)), with_rejects=False))


_STAGED: dict[tuple[str, str], DataFrame] = {}


def staging_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the dirty raw rows as landed in staging (landed once per input)."""
    return _once(spark, _root(spark, sf_dir, "dirty") + "/staging",
                 lambda p: land_raw(dirty_raw(sensor_readings(spark, sf_dir)), p))


def staged_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged rows (the non-empty check runs once per application)."""
    key = (spark.sparkContext.applicationId, _root(spark, sf_dir, "dirty"))
    with _LOCK:
        if key not in _STAGED:
            _STAGED[key] = read_staged(spark, staging_path(spark, sf_dir))
    return _STAGED[key]


def source_csv(spark: SparkSession, sf_dir: str) -> str:
    """The clean readings written once as a source-format CSV folder."""
    from plantpulse.sources.files import write_source_csv

    with _LOCK:
        return _once(spark, _root(spark, sf_dir, "csv"), lambda p: write_source_csv(sensor_readings(spark, sf_dir), p))


def mixed_csv(spark: SparkSession, sf_dir: str) -> str:
    """The clean readings written once as CSV files of several layouts."""
    with _LOCK:
        return _once(spark, _root(spark, sf_dir, "csv-mixed"), lambda p: write_mixed_csv(sensor_readings(spark, sf_dir), p))


def dirty_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    raw = staged_raw(spark, sf_dir)
    return _get(spark, _root(spark, sf_dir, "dirty") + "/star",
                lambda wh: wh.load(convert(raw)))


def incremental_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """Three loads into one warehouse: even reading ids, odd ids, even ids again.
    The third load must add nothing (re-load protection)."""
    from pyspark.sql import functions as F

    conv = convert(staged_raw(spark, sf_dir))
    halves = [conv.where(F.col("reading_id") % 2 == h) for h in (0, 1, 0)]

    def build(wh: Warehouse) -> None:
        for part in halves:
            wh.load(part)

    return _get(spark, _root(spark, sf_dir, "dirty") + "/incremental", build)


def streamed_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The dirty staging loaded by the streaming front end (catch-up run)."""
    from plantpulse.streaming.incremental import start_incremental_load

    def build(wh: Warehouse) -> None:
        q = start_incremental_load(spark, staging_path(spark, sf_dir), wh, available_now=True)
        q.awaitTermination()
        wh.refresh()

    return _get(spark, _root(spark, sf_dir, "dirty") + "/streamed", build)


_MODELS: dict[tuple[str, str], object] = {}


def trained_models(spark: SparkSession, sf_dir: str):
    """(efficiency model, failure model), fitted once on the training split of
    the clean readings and saved under the shared folder."""
    from pyspark.ml import PipelineModel

    from plantpulse.operators.models import is_test_row, train_efficiency, train_failure

    root = _root(spark, sf_dir, "models")
    key = (spark.sparkContext.applicationId, root)
    with _LOCK:
        if key not in _MODELS:
            train = sensor_readings(spark, sf_dir).where(~is_test_row())
            out = []
            for name, fit in (("efficiency", train_efficiency), ("failure", train_failure)):
                path = _once(spark, f"{root}/{name}", lambda p, fit=fit: fit(train).write().save(p))
                out.append(PipelineModel.load(path))
            _MODELS[key] = tuple(out)
    return _MODELS[key]
