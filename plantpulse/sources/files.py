"""CSV input and the append-only raw staging table (the landing zone).

CSV files are read by *name*.  A catalogue of the input (one row per file, read from the
first records of each file) maps every header to our columns; files that share header and timestamp
layout are scanned together with a schema of their own.  So columns may
come in any order, be missing (their cells count as missing) or be unknown (they are ignored).
"""

from __future__ import annotations

import csv
import io
import re
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantpulse.operators.timestamps import STANDARD, vote
from plantpulse.schema import RAW, SOURCE_COLUMNS, SOURCE_NOTES

#: Records of a file that its timestamp layout is chosen from, and characters read for them at most.
SAMPLE_RECORDS, SAMPLE_CHARS = 64, 1 << 15
#: Files probed at the same time.
PROBES = 16
_WHOLE = "__record"


class CsvFile(NamedTuple):
    path: str
    size: int
    header: tuple[str, ...]
    times: tuple[str, ...]  # a sample of the timestamp cells
    layout: str


def rename_source(df: DataFrame) -> DataFrame:
    """Source header -> legal snake_case names (drops the '%' in three names)."""
    return df.withColumnsRenamed({k: v for k, v in SOURCE_COLUMNS.items() if k in df.columns})


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Data files under a path, folder or glob: no hidden ones, none without content."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    start = jvm.org.apache.hadoop.fs.Path(path)
    fs = start.getFileSystem(conf)
    out, todo = [], list(fs.globStatus(start) or [])
    if not todo:
        raise FileNotFoundError(path)
    while todo:
        st = todo.pop()
        name = st.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        if st.isDirectory():
            todo += list(fs.listStatus(st.getPath()))
        elif st.getLen():
            out.append((st.getPath().toString(), st.getLen()))
    return sorted(out)


def _first_chars(spark: SparkSession, path: str) -> str:
    """The first characters of a file (compressed ones too), through the cluster's file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
        data = codec.createInputStream(stream) if codec is not None else stream
        lines = jvm.org.apache.commons.io.input.BoundedInputStream(data, 4 * SAMPLE_CHARS)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(lines)).decode("utf-8", "replace")
    finally:
        stream.close()


def _probe(spark: SparkSession, path: str, size: int) -> CsvFile | None:
    """A file's header and a sample of its timestamp cells; None for a file of blank lines."""
    text = _first_chars(spark, path).removeprefix("﻿")
    records = [r for _, r in zip(range(SAMPLE_RECORDS + 2), csv.reader(io.StringIO(text, newline="")), strict=False)]
    records = [r for r in records if any(c.strip() for c in r)]
    if not records:
        return None
    header = tuple(records[0])
    at = next((i for i, h in enumerate(header) if SOURCE_COLUMNS.get(h.strip()) == "reading_ts"), None)
    last = None if len(text) < SAMPLE_CHARS else -1  # the last record may be cut
    times = tuple(r[at] for r in records[1:last] if at is not None and at < len(r))
    return CsvFile(path, size, header, times, STANDARD)


def catalogue(spark: SparkSession, path: str) -> list[CsvFile]:
    """One entry per data file: header and timestamp layout.  Bounded by the number of files, like their listing."""
    with ThreadPoolExecutor(PROBES) as pool:
        found = [f for f in pool.map(lambda x: _probe(spark, *x), _listed(spark, path)) if f is not None]
    texts = [(i, t) for i, f in enumerate(found) for t in f.times]
    if not texts:
        return found
    chosen = {r["file"]: r["layout"] for r in vote(spark.createDataFrame(texts, "file int, text string")).collect()}
    return [f._replace(layout=chosen.get(i, STANDARD)) for i, f in enumerate(found)]


def _positions(header: tuple[str, ...]) -> dict[str, int]:
    """Our columns' places in a header; of equal names the first counts."""
    out: dict[str, int] = {}
    for i, name in enumerate(header):
        ours = SOURCE_COLUMNS.get(name.strip())
        if ours is not None:
            out.setdefault(ours, i)
    return out


def _n_cells(record: Column) -> Column:
    """Cells of a CSV record: separators outside quotes, and one."""
    bare = F.regexp_replace(record, r'"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _with_open_quotes(spark: SparkSession, paths: list[str]) -> set[str]:
    """Those files in which some line holds an odd number of quotes, so that a cell may span lines."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    found = spark.read.text(paths).where(quotes % 2 == 1).select(F.col("_metadata.file_path").alias("p")).distinct().collect()
    bare = lambda p: re.sub(r"^\w+:/*", "", p)  # noqa: E731  file:/x and file:///x are the same
    names = {bare(unquote(r["p"])) for r in found}
    return {p for p in paths if bare(p) in names}


def _scan(spark: SparkSession, header: tuple[str, ...], layout: str, paths: list[str], spanning: bool) -> DataFrame:
    """Files of one header and layout in the raw layout, with the notes on each record."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))] + [T.StructField(_WHOLE, T.StringType())])
    cells = (spark.read.schema(schema).option("header", True).option("multiLine", spanning).option("escape", '"')
             .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _WHOLE).csv(paths))
    at = _positions(header)
    ours = [f.name for f in RAW.fields if f.name != "reading_id"]
    n = _n_cells(F.col(_WHOLE))
    error = F.when(n > len(header), F.concat(F.lit("ragged row: "), n.cast("string"), F.lit(f" cells for {len(header)} columns")))
    return cells.select(*[(F.col(f"c{at[c]}") if c in at else F.lit(None).cast("string")).alias(c) for c in ours],
                        error.alias("source_error"), F.lit(layout).alias("ts_layout"))


def _split_bytes(spark: SparkSession) -> int:
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sensor CSV file(s) as raw rows, all cells text, columns taken by the names in each file's header.

    * quoted cells may hold separators, doubled quotes and line breaks;
    * a record with fewer cells than its header ends in missing cells; one with more has no sure
      meaning and gets a ``source_error``, by which the loader rejects it;
    * ``ts_layout`` names the timestamp layout chosen for the file (:mod:`operators.timestamps`);
    * hidden and empty files, and blank lines, are passed over.

    A file in which a cell may span lines cannot be split, so it is one task; other files above the split size are
    split.  Which is which is found by one scan for open quotes over the files above the split size.

    The CSV has no row id; ``reading_id`` is a 64-bit hash of the whole row, so
    it is deterministic and independent of file splits and partitioning (it is
    used only to pick one of two conflicting readings and to name rejects).
    """
    files = catalogue(spark, path)
    split = _split_bytes(spark)
    large = [f.path for f in files if f.size > split]
    open_ = _with_open_quotes(spark, large) if large else set()
    groups: dict[tuple, list[str]] = {}
    for f in files:
        groups.setdefault((f.header, f.layout, f.size <= split or f.path in open_), []).append(f.path)
    out = None
    for (header, layout, spanning), paths in groups.items():
        part = _scan(spark, header, layout, paths, spanning)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], T.StructType([*RAW.fields[1:], *SOURCE_NOTES]))
    cols = [f.name for f in RAW.fields if f.name != "reading_id"]
    return out.select(F.xxhash64(*cols).alias("reading_id"), *cols, *[f.name for f in SOURCE_NOTES])


def write_source_csv(readings: DataFrame, path: str) -> None:
    """Write readings in the source CSV layout (original header, text cells).
    Used to produce CSV input from other tables; the engine itself reads CSV
    only at the edge and works on Parquet after landing."""
    back = {v: k for k, v in SOURCE_COLUMNS.items()}
    (readings.select(*[F.col(c).cast("string").alias(back[c]) for c in SOURCE_COLUMNS.values()])
     .write.mode("overwrite").option("header", True).csv(path))


def land_raw(raw: DataFrame, path: str) -> None:
    """Append raw records to staging, unchanged.  Like any append, running it
    twice lands the records twice; the star loader is the idempotent step."""
    notes = [f.name for f in SOURCE_NOTES if f.name in raw.columns]
    raw.select(*[f.name for f in RAW.fields], *notes).write.mode("append").parquet(path)


def read_staged(spark: SparkSession, path: str, require_rows: bool = True) -> DataFrame:
    """Read all staged raw records (records landed without notes have none).  ``require_rows`` fails fast on an empty
    landing zone (a one-row probe, not a count)."""
    df = spark.read.schema(T.StructType([*RAW.fields, *SOURCE_NOTES])).parquet(path)
    if require_rows and df.isEmpty():
        raise ValueError(f"no staged records under {path}")
    return df


def count_staged(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count(F.lit(1)).alias("n_records"))
