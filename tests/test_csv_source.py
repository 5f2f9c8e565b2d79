"""CSV files by header, cells over several lines, ragged records, timestamp layouts per file."""

from __future__ import annotations

import csv
import datetime as dt
import gzip
import io

import pytest
from pyspark.sql import functions as F

from plantpulse.operators.clean import convert, null_profile
from plantpulse.operators.timestamps import LAYOUTS, STANDARD, parse_as, vote
from plantpulse.schema import SOURCE_COLUMNS
from plantpulse.sources import files
from plantpulse.sources.files import catalogue, land_raw, read_csv, read_staged

NAMES = list(SOURCE_COLUMNS)


def record(header, ts, machine, number, more=(), notes="note"):
    cells = {"Timestamp": ts, "Machine_ID": machine, "Operation_Mode": "Active", "Efficiency_Status": "Low"}
    return [cells.get(n, str(number + NAMES.index(n)) if n in NAMES else notes) for n in header] + list(more)


def write(path, header, records, opener=open):
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows([header, *records])
    with opener(path, "wt", encoding="utf-8") as f:
        f.write(text.getvalue())


def numbers(row):
    """Measure -> its place in the source's header, shown by the cell's value."""
    return {c: row[c] for c in ("temperature_c", "vibration_hz", "power_kw", "latency_ms", "pm_score")}


def test_columns_are_taken_by_name(spark, tmp_path):
    swapped = list(NAMES)
    i, j = swapped.index("Vibration_Hz"), swapped.index("Power_Consumption_kW")
    swapped[i], swapped[j] = swapped[j], swapped[i]
    write(tmp_path / "a.csv", swapped, [record(swapped, "2024-01-01 00:00:00", 1, 100)])
    write(tmp_path / "b.csv", NAMES[::-1], [record(NAMES[::-1], "2024-01-01 00:00:00", 2, 100)])
    extra = ["Site", *NAMES[:4], "Shift", *NAMES[4:], "Vibration_Hz"]
    write(tmp_path / "c.csv", extra, [record(extra, "2024-01-01 00:00:00", 3, 100)[:-1] + ["9999"]])
    few = [n for n in NAMES if n != "Network_Latency_ms"]
    write(tmp_path / "d.csv", few, [record(few, "2024-01-01 00:00:00", 4, 100)])
    got = {r["machine_id"]: r for r in convert(read_csv(spark, str(tmp_path))).collect()}
    want = {c: 100.0 + NAMES.index(n) for n, c in SOURCE_COLUMNS.items() if c in numbers(got[1])}
    assert numbers(got[1]) == numbers(got[2]) == numbers(got[3]) == want
    assert numbers(got[4]) == want | {"latency_ms": 0.0}
    assert all(r["key_reason"] is None for r in got.values())


def test_cells_over_lines_quotes_and_other_encodings(spark, tmp_path):
    header = ["Operator_Note", *NAMES]
    notes = ["two\nlines", 'said "no", left\n\n', "plain", "\n"]
    records = [record(header, "2024-01-01 00:00:00", k, 100, notes=n) for k, n in enumerate(notes)]
    write(tmp_path / "a.csv", ["﻿Operator_Note", *NAMES], records)
    write(tmp_path / "b.csv.gz", header, [record(header, "2024-01-01 00:00:00", 10 + k, 100, notes=n) for k, n in enumerate(notes)], gzip.open)
    got = convert(read_csv(spark, str(tmp_path / "*"))).collect()
    assert sorted(r["machine_id"] for r in got) == [0, 1, 2, 3, 10, 11, 12, 13]
    assert all(r["key_reason"] is None and r["pm_score"] == 100.0 + NAMES.index("Predictive_Maintenance_Score") for r in got)


def test_large_files_are_split_unless_a_cell_spans_lines(spark, tmp_path):
    header = [*NAMES, "Operator_Note"]
    write(tmp_path / "plain.csv", header, [record(header, "2024-01-01 00:00:00", k, 100) for k in range(300)])
    write(tmp_path / "open.csv", header, [record(header, "2024-01-01 00:00:00", 1000 + k, 100, notes="x\ny") for k in range(300)])
    whole = {tuple(r) for r in read_csv(spark, str(tmp_path)).collect()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_csv(spark, str(tmp_path))
        paths = [f.path for f in catalogue(spark, str(tmp_path))]
        assert files._with_open_quotes(spark, paths) == {p for p in paths if p.endswith("open.csv")}
        assert df.rdd.getNumPartitions() > 4
        assert {tuple(r) for r in df.collect()} == whole and len(whole) == 600
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ragged_records(spark, tmp_path):
    long = record(NAMES, "2024-01-01 00:00:00", 1, 100, more=["x", "a,b"])
    short = record(NAMES, "2024-01-01 00:00:00", 2, 100)[:6]
    write(tmp_path / "a.csv", NAMES, [record(NAMES, "2024-01-01 00:00:00", 0, 100), long, short])
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n\n")
    (tmp_path / "header.csv").write_text(",".join(NAMES) + "\n")
    (tmp_path / "_SUCCESS").write_text("x")
    got = {r["machine_id"]: r for r in convert(read_csv(spark, str(tmp_path))).collect()}
    assert set(got) == {0, 1, 2}
    assert got[1]["key_reason"] == "ragged row: 15 cells for 13 columns" and got[0]["key_reason"] is None
    assert got[2]["key_reason"] is None and got[2]["pm_score"] == 0.0 and got[2]["temperature_c"] == 103.0


def test_no_file_and_no_record(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_csv(spark, str(tmp_path / "none"))
    (tmp_path / "empty.csv").write_text("")
    assert read_csv(spark, str(tmp_path)).count() == 0


def test_notes_pass_through_staging(spark, tmp_path):
    write(tmp_path / "a.csv", NAMES, [record(NAMES, "31/01/2024 10:00", 1, 100), record(NAMES, "01/02/2024 10:00", 2, 100, more=["x"])])
    land_raw(read_csv(spark, str(tmp_path / "a.csv")), str(tmp_path / "staged"))
    staged = read_staged(spark, str(tmp_path / "staged"))
    got = {r["machine_id"]: (r["reading_ts"], r["key_reason"]) for r in convert(staged).collect()}
    assert got == {1: (dt.datetime(2024, 1, 31, 10), None), 2: (dt.datetime(2024, 2, 1, 10), "ragged row: 14 cells for 13 columns")}
    assert null_profile(staged).count() == 0


@pytest.mark.parametrize(("text", "layout", "want"), [
    ("2024-01-05T10:11:12.5", "year-month-day", dt.datetime(2024, 1, 5, 10, 11, 12, 500000)),
    ("2024-01-05", "year-month-day", dt.datetime(2024, 1, 5)),
    (" 1/2/2024 3:04 ", "month/day/year", dt.datetime(2024, 1, 2, 3, 4)),
    ("1/2/2024 3:04", "day/month/year", dt.datetime(2024, 2, 1, 3, 4)),
    ("13/2/2024", "month/day/year", None),
    ("1/2/2024 12:30 AM", "month/day/year", dt.datetime(2024, 1, 2, 0, 30)),
    ("1/2/2024 12:30:01 pm", "month/day/year", dt.datetime(2024, 1, 2, 12, 30, 1)),
    ("1/2/2024 13:30 PM", "month/day/year", None),
    ("2024/02/30", "year/month/day", None),
    ("2024/02/29 23:59:59", "year/month/day", dt.datetime(2024, 2, 29, 23, 59, 59)),
    ("05.06.2024 07:08", "day.month.year", dt.datetime(2024, 6, 5, 7, 8)),
    ("05-06-2024 07:08", "month-day-year", dt.datetime(2024, 5, 6, 7, 8)),
    ("20240506 0708", "yearmonthday", None),
    ("20240506T07:08:09Z", "yearmonthday", dt.datetime(2024, 5, 6, 7, 8, 9)),
    ("2024-01-05 25:00", "year-month-day", None), ("", "year-month-day", None), (None, "month/day/year", None), ("bad", "day.month.year", None),
])
def test_layouts(spark, text, layout, want):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # must not matter
    try:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(parse_as(F.col("t"), layout)).first()[0] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_vote_decides_ambiguity_as_documented(spark):
    samples = {"all ambiguous": ["01/02/2024", "03/04/2024"], "one day beyond 12": ["01/02/2024", "13/02/2024"],
               "mostly standard": ["2024-01-01", "2024-01-02", "1/2/2024"], "nothing": ["x", None], "dots": ["1.2.2024 10:00"]}
    rows = [(k, t) for k, ts in samples.items() for t in ts]
    got = {r["file"]: r["layout"] for r in vote(spark.createDataFrame(rows, "file string, text string")).collect()}
    assert got == {"all ambiguous": "month/day/year", "one day beyond 12": "day/month/year", "mostly standard": STANDARD,
                   "nothing": STANDARD, "dots": "day.month.year"}
    assert STANDARD == next(iter(LAYOUTS))


def test_each_file_has_its_own_layout(spark, tmp_path):
    write(tmp_path / "us.csv", NAMES, [record(NAMES, t, 1, 100) for t in ("01/02/2024 10:00", "12/31/2024 10:00")])
    write(tmp_path / "eu.csv", NAMES, [record(NAMES, t, 2, 100) for t in ("01/02/2024 10:00", "31/12/2024 10:00", "2024-01-01")])
    got = {(r["machine_id"], r["reading_ts"], r["key_reason"]) for r in convert(read_csv(spark, str(tmp_path))).collect()}
    end = dt.datetime(2024, 12, 31, 10)
    assert got == {(1, dt.datetime(2024, 1, 2, 10), None), (1, end, None), (2, dt.datetime(2024, 2, 1, 10), None), (2, end, None),
                   (2, None, "bad reading_ts")}
