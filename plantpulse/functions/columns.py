"""Column expressions shared by the loaders and the analyses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantpulse.schema import (
    ACTIVE_MODE, FAILURE_ERROR_PCT, RISK_ERROR_PCT, RISK_SCORE, TEMPERATURE_BAND_EDGES,
)

__all__ = [
    "col_", "time_key_of", "ts_of_time_key", "MICROS_PER_HOUR", "temperature_band",
    "temperature_band_no", "TEMPERATURE_BAND_LABELS", "operating_state", "is_active",
    "day_type", "is_failure", "risk_label", "safe_ratio",
]

MICROS_PER_HOUR = 3_600_000_000

# Fixed labels (our own wording) for the four temperature bands, in band order.
TEMPERATURE_BAND_LABELS = ("low (<50)", "normal (50-70)", "high (70-85)", "very high (>85)")
OPERATING_STATES = ("active", "idle/maintenance")
DAY_TYPES = ("weekend", "weekday")


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def time_key_of(ts: str | Column = "reading_ts") -> Column:
    """Surrogate time key = microseconds since 1970-01-01 (a bijection with the
    timestamp, so facts never need a lookup join to find it or to go back)."""
    return F.timestamp_diff("MICROSECOND", _epoch(), col_(ts))


def ts_of_time_key(key: str | Column = "time_key") -> Column:
    """Inverse of :func:`time_key_of` (timestamp without time zone)."""
    return F.timestamp_add("MICROSECOND", col_(key), _epoch())


def temperature_band(t: str | Column = "temperature_c") -> Column:
    """First-match bands with inclusive edges: 50 and 70 fall in the second band,
    85 in the third; NULL falls through to the hottest band (as a CASE ELSE)."""
    t = col_(t)
    lo, mid, hi = TEMPERATURE_BAND_EDGES
    return (F.when(t < lo, TEMPERATURE_BAND_LABELS[0])
            .when(t.between(lo, mid), TEMPERATURE_BAND_LABELS[1])
            .when(t.between(mid, hi), TEMPERATURE_BAND_LABELS[2])
            .otherwise(TEMPERATURE_BAND_LABELS[3]))


def temperature_band_no(t: str | Column = "temperature_c") -> Column:
    t = col_(t)
    lo, mid, hi = TEMPERATURE_BAND_EDGES
    return (F.when(t < lo, 1).when(t.between(lo, mid), 2)
            .when(t.between(mid, hi), 3).otherwise(4))


def is_active(mode: str | Column = "operation_mode") -> Column:
    return col_(mode) == F.lit(ACTIVE_MODE)


def operating_state(mode: str | Column = "operation_mode") -> Column:
    """'active' for mode Active, everything else (including NULL) idle/maintenance."""
    return F.when(is_active(mode), OPERATING_STATES[0]).otherwise(OPERATING_STATES[1])


def day_type(ts: str | Column = "reading_ts") -> Column:
    """Saturday and Sunday are the weekend (dayofweek: Sunday = 1, Saturday = 7)."""
    return F.when(F.dayofweek(col_(ts)).isin(1, 7), DAY_TYPES[0]).otherwise(DAY_TYPES[1])


def is_failure(err: str | Column = "error_rate_pct") -> Column:
    return col_(err) > F.lit(FAILURE_ERROR_PCT)


def risk_label(score: str | Column = "pm_score", err: str | Column = "error_rate_pct") -> Column:
    """Classifier target: 1 when the maintenance score or the error rate is high.
    A missing value counts as 'not high'.  Note it is a function of two of the
    model's own features, so a near-perfect score on it proves nothing."""
    return F.when((col_(score) > RISK_SCORE) | (col_(err) > RISK_ERROR_PCT), 1).otherwise(0)


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL when den is 0 (an aggregate then ignores the row)."""
    return F.try_divide(col_(num), col_(den))
