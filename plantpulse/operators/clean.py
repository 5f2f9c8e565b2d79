"""Cleaning and type conversion with a rejects table (dead-letter rows).

One projection does all of it (no shuffle): parse the two keys, fill missing
cells, try-cast every measure, and record *why* a row cannot go into each fact.
The two facts are judged separately, so a bad defect rate keeps a row out of
the quality fact only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.operators.timestamps import parse_by
from plantpulse.schema import CATEGORIES, MEASURES, PRODUCTION_MEASURES, QUALITY_MEASURES, SOURCE_NOTES

REASON_COLS = ("key_reason", "production_reason", "quality_reason")
_EPOCH_TEXT = "1970-01-01 00:00:00"


def _note(df: DataFrame, name: str) -> Column:
    """A source's note on a row, NULL where the rows have none."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def parse_ts(df: DataFrame, col: str = "reading_ts") -> DataFrame:
    """String timestamp -> TIMESTAMP_NTZ, by the layout noted for the row (else the standard one);
    an unparsable value becomes NULL."""
    return df.withColumn(col, parse_by(F.col(col), _note(df, "ts_layout")) if "ts_layout" in df.columns
                         else F.col(col).try_cast("timestamp_ntz"))


#: Texts that the usual CSV reader (pandas ``read_csv``) takes for a missing cell.
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def blank_missing(raw: DataFrame) -> DataFrame:
    """Text cells that stand for a missing value become NULL."""
    return raw.withColumns({f.name: F.when(~F.col(f.name).isin(MISSING_TEXTS), F.col(f.name))
                            for f in raw.schema.fields if f.dataType.simpleString() == "string"})


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing cells per column, only for columns that have any.

    One aggregate pass (partial counts per task, one tiny final merge), then
    an unpivot of the single result row."""
    notes = [f.name for f in SOURCE_NOTES]
    columns = columns or [c for c in df.columns if c != "reading_id" and c not in notes]
    df = blank_missing(df)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return (counts.unpivot([], columns, "column_name", "n_null")
            .where(F.col("n_null") > 0))


def fill_missing(raw: DataFrame, timestamp: str = "reject") -> DataFrame:
    """Fill every missing measure with 0 and every missing category with '0'.

    ``timestamp='reject'`` (default) leaves a missing timestamp missing so the
    row is rejected; ``'zero'`` reproduces filling it with the epoch (a fake
    1970 reading, which would pollute any daily analysis) and a missing machine
    id with 0.  Texts that stand for a missing value count as missing."""
    raw = blank_missing(raw)
    fills = {m: F.coalesce(F.col(m), F.lit("0")) for m in MEASURES}
    fills.update({c: F.coalesce(F.col(c), F.lit("0")) for c in CATEGORIES})
    if timestamp == "zero":
        fills["reading_ts"] = F.coalesce(F.col("reading_ts"), F.lit(_EPOCH_TEXT))
        if "ts_layout" in raw.columns:  # the filled text is in the standard layout
            fills["ts_layout"] = F.when(F.col("reading_ts").isNotNull(), F.col("ts_layout"))
        fills["machine_id"] = F.coalesce(F.col("machine_id"), F.lit("0"))
    elif timestamp != "reject":
        raise ValueError("timestamp must be 'reject' or 'zero'")
    return raw.withColumns(fills)


def _bad_measures(cols: list[str]) -> Column:
    parts = [F.when(F.col(f"_{c}_bad"), F.lit(f"bad {c}")) for c in cols]
    s = F.concat_ws("; ", *parts)
    return F.when(s != "", s)


def _number(col: str) -> Column:
    """The number in a text; NULL where there is none, and for NaN and infinities."""
    x = F.col(col).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def convert(raw: DataFrame, timestamp: str = "reject") -> DataFrame:
    """Raw strings -> typed readings plus three reason columns.

    ``key_reason``: the source's error, or machine id or timestamp missing / unparsable (both facts).
    ``production_reason`` / ``quality_reason``: the key reason, else the list
    of measures of that fact that do not parse.  NULL means loadable.
    """
    filled = fill_missing(raw, timestamp)
    mid = F.col("machine_id").try_cast("int")
    ts = parse_by(F.col("reading_ts"), _note(filled, "ts_layout")) if "ts_layout" in filled.columns \
        else F.col("reading_ts").try_cast("timestamp_ntz")
    error = _note(filled, "source_error")
    key_reason = (F.when(error.isNotNull(), error)
                  .when(F.col("machine_id").isNull(), "missing machine_id")
                  .when(mid.isNull(), "bad machine_id")
                  .when(F.col("reading_ts").isNull(), "missing reading_ts")
                  .when(ts.isNull(), "bad reading_ts"))
    typed = filled.select(
        "reading_id",
        mid.alias("machine_id"),
        ts.alias("reading_ts"),
        *CATEGORIES,
        *[_number(m).alias(m) for m in MEASURES],
        *[_number(m).isNull().alias(f"_{m}_bad") for m in MEASURES],
        key_reason.alias("key_reason"),
    )
    out = typed.withColumns({
        "production_reason": F.coalesce(F.col("key_reason"), _bad_measures(PRODUCTION_MEASURES)),
        "quality_reason": F.coalesce(F.col("key_reason"), _bad_measures(QUALITY_MEASURES)),
    })
    return out.drop(*[f"_{m}_bad" for m in MEASURES])


def as_converted(readings: DataFrame) -> DataFrame:
    """Already-typed clean readings in the ``convert`` layout (no rejects)."""
    none = F.lit(None).cast("string")
    return readings.withColumns({c: none for c in REASON_COLS})


def good_rows(converted: DataFrame, target: str) -> DataFrame:
    """Rows loadable into ``target`` ('production' | 'quality' | 'keys')."""
    col = {"production": "production_reason", "quality": "quality_reason",
           "keys": "key_reason"}[target]
    return converted.where(F.col(col).isNull()).drop(*REASON_COLS)


def rejects(converted: DataFrame) -> DataFrame:
    """One row per raw row that cannot go into at least one fact.

    target: 'both' | 'production' | 'quality'; reason: the key reason, or the
    unparsable measures of each refused fact."""
    p, q = F.col("production_reason"), F.col("quality_reason")
    target = (F.when(p.isNotNull() & q.isNotNull(), "both")
              .when(p.isNotNull(), "production").otherwise("quality"))
    reason = (F.when(p.isNotNull() & q.isNotNull() & (p != q), F.concat_ws("; ", p, q))
              .otherwise(F.coalesce(p, q)))
    return (converted.where(p.isNotNull() | q.isNotNull())
            .select("reading_id", target.alias("target"), reason.alias("reason")))


def strict_check(converted: DataFrame) -> None:
    """Optional all-or-nothing mode: raise if any row has a bad key."""
    bad = converted.where(F.col("key_reason").isNotNull()).limit(1).collect()
    if bad:
        raise ValueError(f"unparsable key in reading {bad[0]['reading_id']}: {bad[0]['key_reason']}")

