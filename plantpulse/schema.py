"""Schemas, column names and fixed thresholds."""

from __future__ import annotations

from pyspark.sql import types as T

__all__ = [
    "ACTIVE_MODE", "FAILURE_ERROR_PCT", "RISK_SCORE", "RISK_ERROR_PCT",
    "HIGH_TEMPERATURE_C", "HIGH_VIBRATION_HZ", "ABNORMAL_VIBRATION_MEAN",
    "ABNORMAL_VIBRATION_SD", "TEMPERATURE_BAND_EDGES", "TOP_N", "HISTOGRAM_BINS",
    "SOURCE_COLUMNS", "MEASURES", "PRODUCTION_MEASURES", "QUALITY_MEASURES",
    "CATEGORIES", "FEATURES", "RAW", "SOURCE_NOTES", "READINGS", "MACHINE_DIM", "TIME_DIM",
    "PRODUCTION_FACT", "QUALITY_FACT", "WIDE_FACT", "PRODUCTION_ROLLUP", "PAIRED_ROLLUP", "PAIRED_MEASURES", "REJECTS", "STAR_SCHEMAS",
]

# ---------------------------------------------------------------------------
# These must equal the source data / the analyses' definitions.
# ---------------------------------------------------------------------------
ACTIVE_MODE = "Active"              # the only operation-mode literal any analysis tests
FAILURE_ERROR_PCT = 5.0             # a reading "fails" when its error rate is above this
RISK_SCORE = 0.8                    # classifier failure label: maintenance score above this
RISK_ERROR_PCT = 10.0               # ... or error rate above this
HIGH_TEMPERATURE_C = 85.0           # temperature alert: strictly above
HIGH_VIBRATION_HZ = 4.5             # vibration alert: strictly above
ABNORMAL_VIBRATION_MEAN = 3.5       # abnormal vibration: mean above this ...
ABNORMAL_VIBRATION_SD = 1.2         # ... or sample standard deviation above this
TEMPERATURE_BAND_EDGES = (50.0, 70.0, 85.0)   # bands: <50, [50,70], [70,85], else
TOP_N = 10                          # size of the two top-k reports
HISTOGRAM_BINS = 30                 # maintenance-score histogram: at most 30 bins

# Source CSV header -> our column name (the CSV header is a fixed external format).
SOURCE_COLUMNS = {
    "Timestamp": "reading_ts",
    "Machine_ID": "machine_id",
    "Operation_Mode": "operation_mode",
    "Temperature_C": "temperature_c",
    "Vibration_Hz": "vibration_hz",
    "Power_Consumption_kW": "power_kw",
    "Network_Latency_ms": "latency_ms",
    "Packet_Loss_%": "packet_loss_pct",
    "Quality_Control_Defect_Rate_%": "defect_rate_pct",
    "Production_Speed_units_per_hr": "speed_uph",
    "Predictive_Maintenance_Score": "pm_score",
    "Error_Rate_%": "error_rate_pct",
    "Efficiency_Status": "efficiency_status",
}

PRODUCTION_MEASURES = ["temperature_c", "vibration_hz", "power_kw", "speed_uph", "error_rate_pct"]
QUALITY_MEASURES = ["defect_rate_pct", "latency_ms", "packet_loss_pct", "pm_score"]
MEASURES = PRODUCTION_MEASURES + QUALITY_MEASURES
CATEGORIES = ["operation_mode", "efficiency_status"]

# Classifier features: nine measures plus the encoded operation mode.
FEATURES = [
    "temperature_c", "vibration_hz", "power_kw", "latency_ms", "packet_loss_pct",
    "defect_rate_pct", "speed_uph", "pm_score", "error_rate_pct", "operation_mode_code",
]


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


S, D = T.StringType(), T.DoubleType()

# Raw landing layer: everything but the id stays a string, so one bad cell is a
# reject, not a failed read.
RAW = _struct(
    ("reading_id", T.LongType(), True),
    ("reading_ts", S, True), ("machine_id", S, True),
    ("operation_mode", S, True), ("efficiency_status", S, True),
    *[(m, S, True) for m in MEASURES],
)

# What a file source adds to a raw row: why a record cannot be read, and its file's timestamp layout.
SOURCE_NOTES = [T.StructField("source_error", S, True), T.StructField("ts_layout", S, True)]

READINGS = _struct(
    ("reading_id", T.LongType(), True),
    ("machine_id", T.IntegerType(), True),
    ("reading_ts", T.TimestampNTZType(), True),
    ("operation_mode", S, True), ("efficiency_status", S, True),
    *[(m, D, True) for m in MEASURES],
)

MACHINE_DIM = _struct(
    ("machine_key", T.IntegerType(), False),
    ("machine_id", T.IntegerType(), False),
    ("load_ts", T.TimestampType(), True),
)

TIME_DIM = _struct(
    ("time_key", T.LongType(), False),
    ("reading_ts", T.TimestampNTZType(), False),
    ("hour", T.IntegerType(), True),
    ("minute", T.IntegerType(), True),
    ("load_ts", T.TimestampType(), True),
)

PRODUCTION_FACT = _struct(
    ("machine_key", T.IntegerType(), False),
    ("time_key", T.LongType(), False),
    *[(m, D, True) for m in PRODUCTION_MEASURES],
    ("efficiency_status", S, True),
    ("operation_mode", S, True),
    ("load_ts", T.TimestampType(), True),
)

QUALITY_FACT = _struct(
    ("machine_key", T.IntegerType(), False),
    ("time_key", T.LongType(), False),
    *[(m, D, True) for m in QUALITY_MEASURES],
    ("load_ts", T.TimestampType(), True),
)

# Production and quality of one reading side by side (only readings that are in both facts).
WIDE_FACT = _struct(
    ("machine_key", T.IntegerType(), False),
    ("time_key", T.LongType(), False),
    *[(m, D, True) for m in MEASURES],
    ("efficiency_status", S, True),
    ("operation_mode", S, True),
    ("load_ts", T.TimestampType(), True),
)

_ROLLUP_KEYS = [("machine_key", T.IntegerType(), True), ("day", T.DateType(), True), ("hour", T.IntegerType(), True),
                ("operation_mode", S, True), ("efficiency_status", S, True)]

# Mergeable sums per (machine, day, hour, mode, status): of the production fact, and of the wide fact.
# Per measure: non-null count, sum, extremes, and sum of squared deviations from the row's own mean.
PRODUCTION_ROLLUP = _struct(
    *_ROLLUP_KEYS, ("n", T.LongType(), True), ("n_failures", T.LongType(), True),
    ("first_failure", T.LongType(), True), ("last_failure", T.LongType(), True),
    ("energy_n", T.LongType(), True), ("energy_sum", D, True),  # power per unit of speed, reading by reading
    *[x for m in PRODUCTION_MEASURES for x in (
        (f"{m}_n", T.LongType(), True), *[(f"{m}_{part}", D, True) for part in ("sum", "min", "max", "m2")])],
)
PAIRED_MEASURES = ["speed_uph", "error_rate_pct", "defect_rate_pct"]
PAIRED_ROLLUP = _struct(
    *_ROLLUP_KEYS, ("n", T.LongType(), True),
    *[x for m in PAIRED_MEASURES for x in (
        (f"{m}_n", T.LongType(), True), (f"{m}_sum", D, True), (f"{m}_max", D, True))],
)

REJECTS = _struct(
    ("reading_id", T.LongType(), True),
    ("target", S, False),
    ("reason", S, False),
)

STAR_SCHEMAS = {
    "machine_dim": MACHINE_DIM,
    "time_dim": TIME_DIM,
    "production_fact": PRODUCTION_FACT,
    "quality_fact": QUALITY_FACT,
    "wide_fact": WIDE_FACT,
    "production_rollup": PRODUCTION_ROLLUP,
    "paired_rollup": PAIRED_ROLLUP,
}
