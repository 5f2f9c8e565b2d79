"""Independent SQL statements (DuckDB dialect) for every registered query.

They compute from the flat readings -- never through a star -- so agreement
also shows the star load is lossless.  Tables ``events`` etc. are views.
"""

from __future__ import annotations

# Fixed fixture rule (same text as the Spark fixture in sources/fixture.py).
READINGS_CTE = """readings AS (
  SELECT event_id AS reading_id, CAST(user_id AS INT) AS machine_id, ts AS reading_ts,
    40  + CAST((event_id*37 + user_id*11) % 240  AS DOUBLE)/4  AS temperature_c,
    1.5 + CAST((event_id*53 + user_id*7)  % 256  AS DOUBLE)/64 AS vibration_hz,
    1.5 + CAST((event_id*29 + user_id*3)  % 136  AS DOUBLE)/16 AS power_kw,
    50  + CAST((event_id*41 + user_id*17) % 1800 AS DOUBLE)/4  AS speed_uph,
    CAST(((event_id*61 + user_id*5) % 16) * ((event_id*7 + user_id) % 15) AS DOUBLE)/16 AS error_rate_pct,
    CAST((event_id*43 + user_id*13) % 160 AS DOUBLE)/16 AS defect_rate_pct,
    CAST((event_id*19 + user_id*23) % 400 AS DOUBLE)/8  AS latency_ms,
    CAST((event_id*31 + user_id*2)  % 80  AS DOUBLE)/16 AS packet_loss_pct,
    CAST((event_id*47 + user_id*29) % 65  AS DOUBLE)/64 AS pm_score,
    CASE WHEN event_type IN ('view','click','purchase') THEN 'Active'
         WHEN event_type = 'signup' THEN 'Idle' ELSE 'Maintenance' END AS operation_mode,
    CASE WHEN value < 20 THEN 'Low' WHEN value < 60 THEN 'Medium' ELSE 'High' END AS efficiency_status
  FROM events)"""

# Fault injection (same rules as sources/fixture.dirty_raw), then the cleaning
# rules of operators/clean.convert written out in SQL.
DIRTY_CTE = READINGS_CTE + """,
raw1 AS (
  SELECT reading_id,
    CASE WHEN reading_id % 103 = 0 THEN NULL ELSE CAST(reading_ts AS VARCHAR) END AS reading_ts,
    CASE WHEN reading_id % 211 = 0 THEN 'bad' ELSE CAST(machine_id AS VARCHAR) END AS machine_id,
    operation_mode, efficiency_status,
    CASE WHEN reading_id % 97 = 0 THEN NULL WHEN reading_id % 101 = 0 THEN 'bad'
         ELSE CAST(temperature_c AS VARCHAR) END AS temperature_c,
    CAST(vibration_hz AS VARCHAR) AS vibration_hz, CASE WHEN reading_id % 109 = 0 THEN NULL ELSE CAST(power_kw AS VARCHAR) END AS power_kw,
    CAST(speed_uph AS VARCHAR) AS speed_uph, CAST(error_rate_pct AS VARCHAR) AS error_rate_pct,
    CASE WHEN reading_id % 107 = 0 THEN 'bad' ELSE CAST(defect_rate_pct AS VARCHAR) END AS defect_rate_pct,
    CASE WHEN reading_id % 127 = 0 THEN NULL ELSE CAST(latency_ms AS VARCHAR) END AS latency_ms, CAST(packet_loss_pct AS VARCHAR) AS packet_loss_pct,
    CAST(pm_score AS VARCHAR) AS pm_score
  FROM readings),
raw AS (SELECT * FROM raw1 UNION ALL SELECT * FROM raw1 WHERE reading_id % 89 = 0),
conv0 AS (
  SELECT reading_id,
    TRY_CAST(machine_id AS INTEGER) AS machine_id,
    TRY_CAST(reading_ts AS TIMESTAMP) AS reading_ts,
    COALESCE(operation_mode, '0') AS operation_mode, COALESCE(efficiency_status, '0') AS efficiency_status,
    TRY_CAST(COALESCE(temperature_c, '0') AS DOUBLE) AS temperature_c,
    TRY_CAST(COALESCE(vibration_hz, '0') AS DOUBLE) AS vibration_hz,
    TRY_CAST(COALESCE(power_kw, '0') AS DOUBLE) AS power_kw,
    TRY_CAST(COALESCE(speed_uph, '0') AS DOUBLE) AS speed_uph,
    TRY_CAST(COALESCE(error_rate_pct, '0') AS DOUBLE) AS error_rate_pct,
    TRY_CAST(COALESCE(defect_rate_pct, '0') AS DOUBLE) AS defect_rate_pct,
    TRY_CAST(COALESCE(latency_ms, '0') AS DOUBLE) AS latency_ms,
    TRY_CAST(COALESCE(packet_loss_pct, '0') AS DOUBLE) AS packet_loss_pct,
    TRY_CAST(COALESCE(pm_score, '0') AS DOUBLE) AS pm_score,
    CASE WHEN machine_id IS NULL THEN 'missing machine_id'
         WHEN TRY_CAST(machine_id AS INTEGER) IS NULL THEN 'bad machine_id'
         WHEN reading_ts IS NULL THEN 'missing reading_ts'
         WHEN TRY_CAST(reading_ts AS TIMESTAMP) IS NULL THEN 'bad reading_ts' END AS key_reason
  FROM raw),
conv AS (
  SELECT *,
    COALESCE(key_reason, NULLIF(CONCAT_WS('; ',
      CASE WHEN temperature_c IS NULL THEN 'bad temperature_c' END,
      CASE WHEN vibration_hz IS NULL THEN 'bad vibration_hz' END,
      CASE WHEN power_kw IS NULL THEN 'bad power_kw' END,
      CASE WHEN speed_uph IS NULL THEN 'bad speed_uph' END,
      CASE WHEN error_rate_pct IS NULL THEN 'bad error_rate_pct' END), '')) AS production_reason,
    COALESCE(key_reason, NULLIF(CONCAT_WS('; ',
      CASE WHEN defect_rate_pct IS NULL THEN 'bad defect_rate_pct' END,
      CASE WHEN latency_ms IS NULL THEN 'bad latency_ms' END,
      CASE WHEN packet_loss_pct IS NULL THEN 'bad packet_loss_pct' END,
      CASE WHEN pm_score IS NULL THEN 'bad pm_score' END), '')) AS quality_reason
  FROM conv0)"""


def _with(cte: str, body: str) -> str:
    return f"WITH {cte}\n{body}"


def r(body: str) -> str:
    """Statement over the clean readings."""
    return _with(READINGS_CTE, body)


def d(body: str) -> str:
    """Statement over the dirty raw rows and their conversion."""
    return _with(DIRTY_CTE, body)


ACTIVE = "operation_mode = 'Active'"
PPU = "ROUND(AVG(power_kw / NULLIF(speed_uph, 0)), 9)"
BAND = """CASE WHEN temperature_c < 50 THEN 'low (<50)'
       WHEN temperature_c BETWEEN 50 AND 70 THEN 'normal (50-70)'
       WHEN temperature_c BETWEEN 70 AND 85 THEN 'high (70-85)'
       ELSE 'very high (>85)' END"""
BAND_NO = """CASE WHEN temperature_c < 50 THEN 1 WHEN temperature_c BETWEEN 50 AND 70 THEN 2
       WHEN temperature_c BETWEEN 70 AND 85 THEN 3 ELSE 4 END"""

ANALYSES_SQL = {
    "machine_efficiency": r("""
SELECT machine_id, efficiency_status, AVG(speed_uph) AS avg_speed,
       AVG(error_rate_pct) AS avg_error_rate, COUNT(*) AS n_readings
FROM readings GROUP BY machine_id, efficiency_status
ORDER BY avg_speed DESC, machine_id, efficiency_status"""),
    "oee_two_factor": r("""
SELECT machine_id, AVG(speed_uph) / NULLIF(MAX(speed_uph), 0) AS speed_ratio,
       1 - AVG(defect_rate_pct) / 100 AS quality,
       (AVG(speed_uph) / NULLIF(MAX(speed_uph), 0)) * (1 - AVG(defect_rate_pct) / 100) AS oee
FROM readings GROUP BY machine_id ORDER BY oee DESC, machine_id"""),
    "defects_by_temperature": r(f"""
SELECT {BAND} AS temperature_band, AVG(defect_rate_pct) AS avg_defect_rate, COUNT(*) AS n_readings
FROM readings GROUP BY 1 ORDER BY avg_defect_rate DESC"""),
    "hourly_performance": r("""
SELECT CAST(hour(reading_ts) AS INTEGER) AS hour, AVG(speed_uph) AS avg_speed,
       AVG(error_rate_pct) AS avg_error_rate, COUNT(*) AS n_readings
FROM readings GROUP BY 1 ORDER BY 1"""),
    "active_vs_idle": r(f"""
SELECT CASE WHEN {ACTIVE} THEN 'active' ELSE 'idle/maintenance' END AS operating_state,
       COUNT(*) AS n_readings, AVG(temperature_c) AS avg_temperature,
       AVG(vibration_hz) AS avg_vibration, AVG(power_kw) AS avg_power
FROM readings GROUP BY 1"""),
    "top_defect_machines": r("""
SELECT machine_id, AVG(defect_rate_pct) AS avg_defect_rate, COUNT(*) AS n_readings
FROM readings GROUP BY machine_id ORDER BY avg_defect_rate DESC, machine_id LIMIT 10"""),
    "defects_by_temperature_band_order": r(f"""
SELECT {BAND_NO} AS band_no, {BAND} AS temperature_band,
       AVG(defect_rate_pct) AS avg_defect_rate, COUNT(*) AS n_readings
FROM readings GROUP BY 1, 2 ORDER BY band_no"""),
    "energy_by_mode": r("""
SELECT operation_mode, AVG(power_kw) AS avg_power, MIN(power_kw) AS min_power,
       MAX(power_kw) AS max_power, COUNT(*) AS n_readings
FROM readings GROUP BY operation_mode ORDER BY avg_power DESC"""),
    "least_energy_efficient": r(f"""
SELECT machine_id, {PPU} AS avg_power_per_unit, AVG(power_kw) AS avg_power, AVG(speed_uph) AS avg_speed
FROM readings WHERE {ACTIVE} GROUP BY machine_id
ORDER BY avg_power_per_unit DESC NULLS LAST, machine_id LIMIT 10"""),
    "abnormal_vibration": r(f"""
SELECT machine_id, AVG(vibration_hz) AS avg_vibration, ROUND(STDDEV_SAMP(vibration_hz), 6) AS sd_vibration,
       MAX(vibration_hz) AS max_vibration, COUNT(*) AS n_readings
FROM readings WHERE {ACTIVE} GROUP BY machine_id
HAVING AVG(vibration_hz) > 3.5 OR STDDEV_SAMP(vibration_hz) > 1.2
ORDER BY avg_vibration DESC, machine_id"""),
    "pre_failure_conditions": r("""
, f AS (
  SELECT machine_id,
    LAG(temperature_c, 1) OVER w AS prev_t, LAG(vibration_hz, 1) OVER w AS prev_v,
    LAG(power_kw, 1) OVER w AS prev_p
  FROM readings WHERE error_rate_pct > 5
  WINDOW w AS (PARTITION BY machine_id ORDER BY reading_ts))
SELECT machine_id, AVG(prev_t) AS avg_prev_temperature, AVG(prev_v) AS avg_prev_vibration,
       AVG(prev_p) AS avg_prev_power, COUNT(*) AS n_failures
FROM f GROUP BY machine_id"""),
    "oee_three_factor": r(f"""
SELECT machine_id,
  AVG(CASE WHEN {ACTIVE} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS availability,
  AVG(speed_uph) / NULLIF(MAX(speed_uph), 0) AS performance,
  1 - AVG(defect_rate_pct) / 100 AS quality,
  AVG(CASE WHEN {ACTIVE} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)
    * (AVG(speed_uph) / NULLIF(MAX(speed_uph), 0)) * (1 - AVG(defect_rate_pct) / 100) AS oee,
  COUNT(*) AS n_readings
FROM readings GROUP BY machine_id ORDER BY oee DESC, machine_id"""),
    "daily_trend": r("""
SELECT CAST(reading_ts AS DATE) AS reading_date, AVG(speed_uph) AS avg_speed,
       AVG(error_rate_pct) AS avg_error_rate, AVG(defect_rate_pct) AS avg_defect_rate,
       COUNT(*) AS n_readings
FROM readings GROUP BY 1 ORDER BY 1"""),
    "weekday_vs_weekend": r("""
SELECT CASE WHEN dayofweek(reading_ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_type,
       AVG(speed_uph) AS avg_speed, AVG(error_rate_pct) AS avg_error_rate,
       AVG(power_kw) AS avg_power, COUNT(*) AS n_readings
FROM readings GROUP BY 1"""),
    "latest_status": r("""
SELECT machine_id, operation_mode, temperature_c, vibration_hz, speed_uph, error_rate_pct,
       efficiency_status, reading_ts
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY machine_id ORDER BY reading_ts DESC) AS rn
      FROM readings) WHERE rn = 1 ORDER BY machine_id"""),
    "alerts": r("""
SELECT * FROM (
  SELECT machine_id, 'high temperature' AS alert_kind, temperature_c AS alert_value, reading_ts
  FROM readings WHERE temperature_c > 85
  UNION ALL
  SELECT machine_id, 'excessive vibration' AS alert_kind, vibration_hz AS alert_value, reading_ts
  FROM readings WHERE vibration_hz > 4.5)
ORDER BY reading_ts DESC, machine_id, alert_kind"""),
    "productivity_ranking": r(f"""
, a AS (
  SELECT machine_id, AVG(speed_uph) AS avg_speed, AVG(error_rate_pct) AS avg_error_rate,
         {PPU} AS avg_power_per_unit
  FROM readings WHERE {ACTIVE} GROUP BY machine_id)
SELECT machine_id,
  avg_speed, CAST(RANK() OVER (ORDER BY avg_speed DESC NULLS LAST) AS INTEGER) AS speed_rank,
  avg_error_rate, CAST(RANK() OVER (ORDER BY avg_error_rate ASC NULLS FIRST) AS INTEGER) AS error_rank,
  avg_power_per_unit,
  CAST(RANK() OVER (ORDER BY avg_power_per_unit ASC NULLS FIRST) AS INTEGER) AS energy_rank
FROM a ORDER BY speed_rank, machine_id"""),
    "deviant_machines": r(f"""
, sd AS (
  SELECT machine_id, STDDEV_SAMP(speed_uph) AS sd_speed, STDDEV_SAMP(temperature_c) AS sd_temperature,
         STDDEV_SAMP(vibration_hz) AS sd_vibration
  FROM readings WHERE {ACTIVE} GROUP BY machine_id),
m AS (SELECT AVG(sd_speed) AS mean_sd_speed, AVG(sd_temperature) AS mean_sd_temperature,
             AVG(sd_vibration) AS mean_sd_vibration FROM sd)
SELECT machine_id, ROUND(sd_speed, 6) AS sd_speed, ROUND(sd_temperature, 6) AS sd_temperature,
       ROUND(sd_vibration, 6) AS sd_vibration, ROUND(mean_sd_speed, 6) AS mean_sd_speed,
       ROUND(mean_sd_temperature, 6) AS mean_sd_temperature, ROUND(mean_sd_vibration, 6) AS mean_sd_vibration
FROM sd CROSS JOIN m
WHERE sd_speed > mean_sd_speed OR sd_temperature > mean_sd_temperature OR sd_vibration > mean_sd_vibration
ORDER BY sd_speed DESC, machine_id"""),
}

ANALYSES_SQL["machine_efficiency_sql"] = ANALYSES_SQL["machine_efficiency"]
ANALYSES_SQL["pre_failure_conditions_any_reading"] = r("""
, f AS (
  SELECT machine_id, error_rate_pct,
    LAG(temperature_c, 1) OVER w AS prev_t, LAG(vibration_hz, 1) OVER w AS prev_v,
    LAG(power_kw, 1) OVER w AS prev_p
  FROM readings
  WINDOW w AS (PARTITION BY machine_id ORDER BY reading_ts))
SELECT machine_id, AVG(prev_t) AS avg_prev_temperature, AVG(prev_v) AS avg_prev_vibration,
       AVG(prev_p) AS avg_prev_power, COUNT(*) AS n_failures
FROM f WHERE error_rate_pct > 5 GROUP BY machine_id""")
ANALYSES_SQL["top_defect_machines_text_order"] = r("""
SELECT machine_id, AVG(defect_rate_pct) AS avg_defect_rate, COUNT(*) AS n_readings
FROM readings GROUP BY machine_id
ORDER BY format('{:,.2f}', round(CAST(AVG(defect_rate_pct) AS DECIMAL(28, 10)), 2)) || '%' DESC, machine_id
LIMIT 10""")

ANALYSES_SQL["least_energy_efficient_text_order"] = r(f"""
SELECT machine_id, {PPU} AS avg_power_per_unit, AVG(power_kw) AS avg_power, AVG(speed_uph) AS avg_speed
FROM readings WHERE {ACTIVE} GROUP BY machine_id
ORDER BY format('{{:,.2f}}', round(CAST({PPU} AS DECIMAL(28, 10)), 2)) || '%' DESC NULLS LAST, machine_id
LIMIT 10""")

ETL_SQL = {
    "readings": r("SELECT * FROM readings"),
    "staged_count": d("SELECT COUNT(*) AS n_records FROM raw"),
    "null_profile": d("""
, n AS (SELECT
  COUNT_IF(reading_ts IS NULL) AS reading_ts, COUNT_IF(machine_id IS NULL) AS machine_id,
  COUNT_IF(operation_mode IS NULL) AS operation_mode, COUNT_IF(efficiency_status IS NULL) AS efficiency_status,
  COUNT_IF(temperature_c IS NULL) AS temperature_c, COUNT_IF(vibration_hz IS NULL) AS vibration_hz,
  COUNT_IF(power_kw IS NULL) AS power_kw, COUNT_IF(speed_uph IS NULL) AS speed_uph,
  COUNT_IF(error_rate_pct IS NULL) AS error_rate_pct, COUNT_IF(defect_rate_pct IS NULL) AS defect_rate_pct,
  COUNT_IF(latency_ms IS NULL) AS latency_ms, COUNT_IF(packet_loss_pct IS NULL) AS packet_loss_pct,
  COUNT_IF(pm_score IS NULL) AS pm_score FROM raw)
SELECT column_name, CAST(n_null AS BIGINT) AS n_null
FROM (UNPIVOT n ON COLUMNS(*) INTO NAME column_name VALUE n_null)
WHERE n_null > 0"""),
    "filled_readings": d("""
SELECT reading_id, machine_id, reading_ts, operation_mode, efficiency_status, temperature_c, vibration_hz,
       power_kw, speed_uph, error_rate_pct, defect_rate_pct, latency_ms, packet_loss_pct, pm_score
FROM conv"""),
    "converted_good": d("""
SELECT reading_id, machine_id, reading_ts,
       production_reason IS NULL AS production_ok, quality_reason IS NULL AS quality_ok
FROM conv WHERE production_reason IS NULL OR quality_reason IS NULL"""),
    "converted_rejects": d("""
SELECT reading_id,
  CASE WHEN production_reason IS NOT NULL AND quality_reason IS NOT NULL THEN 'both'
       WHEN production_reason IS NOT NULL THEN 'production' ELSE 'quality' END AS target,
  CASE WHEN production_reason IS NOT NULL AND quality_reason IS NOT NULL
            AND production_reason <> quality_reason
       THEN CONCAT_WS('; ', production_reason, quality_reason)
       ELSE COALESCE(production_reason, quality_reason) END AS reason
FROM conv WHERE production_reason IS NOT NULL OR quality_reason IS NOT NULL"""),
    "machine_dim": d("""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY machine_id) AS INTEGER) AS machine_key, machine_id
FROM (SELECT DISTINCT machine_id FROM conv WHERE key_reason IS NULL)"""),
    "time_dim": d("""
SELECT epoch_us(reading_ts) AS time_key, reading_ts, CAST(hour(reading_ts) AS INTEGER) AS hour,
       CAST(minute(reading_ts) AS INTEGER) AS minute
FROM (SELECT DISTINCT reading_ts FROM conv WHERE key_reason IS NULL)"""),
    "production_fact": d("""
SELECT machine_id, reading_ts, temperature_c, vibration_hz, power_kw, speed_uph, error_rate_pct,
       efficiency_status, operation_mode
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY machine_id, reading_ts ORDER BY reading_id) AS rn
      FROM conv WHERE production_reason IS NULL) WHERE rn = 1"""),
    "quality_fact": d("""
SELECT machine_id, reading_ts, defect_rate_pct, latency_ms, packet_loss_pct, pm_score
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY machine_id, reading_ts ORDER BY reading_id) AS rn
      FROM conv WHERE quality_reason IS NULL) WHERE rn = 1"""),
}

ETL_SQL["streamed_production_fact"] = ETL_SQL["production_fact"]
ETL_SQL["star_readings"] = r("""
SELECT machine_id, reading_ts, operation_mode, efficiency_status, temperature_c, vibration_hz, power_kw,
       speed_uph, error_rate_pct, defect_rate_pct, latency_ms, packet_loss_pct, pm_score
FROM readings""")
ETL_SQL["csv_readings"] = r("""
SELECT machine_id, reading_ts, operation_mode, efficiency_status, temperature_c, vibration_hz, power_kw,
       speed_uph, error_rate_pct, defect_rate_pct, latency_ms, packet_loss_pct, pm_score
FROM readings""")
ETL_SQL["csv_mixed_layouts"] = r("""
SELECT machine_id, reading_ts, operation_mode, efficiency_status, temperature_c, vibration_hz, power_kw,
       speed_uph, error_rate_pct, defect_rate_pct, CASE WHEN reading_id % 4 = 2 THEN 0 ELSE latency_ms END AS latency_ms,
       packet_loss_pct, pm_score
FROM readings WHERE NOT (reading_id % 4 = 0 AND reading_id % 53 = 0)""")
ETL_SQL["csv_mixed_rejects"] = r("""
SELECT 'both' AS target, 'ragged row: 15 cells for 13 columns' AS reason, COUNT(*) AS n
FROM readings WHERE reading_id % 4 = 0 AND reading_id % 53 = 0 HAVING COUNT(*) > 0""")
ETL_SQL["reload_adds_nothing"] = d("""
, h AS (SELECT *, CASE WHEN reading_id % 2 = 0 THEN 1 ELSE 2 END AS step FROM conv),
m AS (SELECT step, COUNT(*) AS n FROM (SELECT machine_id, MIN(step) AS step FROM h
      WHERE key_reason IS NULL GROUP BY machine_id) GROUP BY step),
t AS (SELECT step, COUNT(*) AS n FROM (SELECT reading_ts, MIN(step) AS step FROM h
      WHERE key_reason IS NULL GROUP BY reading_ts) GROUP BY step),
p AS (SELECT step, COUNT(*) AS n FROM (SELECT machine_id, reading_ts, MIN(step) AS step FROM h
      WHERE production_reason IS NULL GROUP BY 1, 2) GROUP BY step),
q AS (SELECT step, COUNT(*) AS n FROM (SELECT machine_id, reading_ts, MIN(step) AS step FROM h
      WHERE quality_reason IS NULL GROUP BY 1, 2) GROUP BY step),
s AS (SELECT * FROM (VALUES (1), (2), (3)) v(step))
SELECT CAST(s.step AS INTEGER) AS step, COALESCE(m.n, 0) AS machines_added, COALESCE(t.n, 0) AS times_added,
       COALESCE(p.n, 0) AS production_added, COALESCE(q.n, 0) AS quality_added
FROM s LEFT JOIN m USING (step) LEFT JOIN t USING (step) LEFT JOIN p USING (step) LEFT JOIN q USING (step)
ORDER BY 1""")

FILTER = ("reading_ts >= TIMESTAMP '2024-01-08' AND reading_ts < TIMESTAMP '2024-01-22' "
          "AND hour(reading_ts) BETWEEN 8 AND 17")
MODE_CODES = """codes AS (SELECT operation_mode,
    CAST(DENSE_RANK() OVER (ORDER BY operation_mode) - 1 AS INTEGER) AS mode_code
  FROM (SELECT DISTINCT operation_mode FROM readings))"""

CHART_SQL = {
    "filtered_readings": r(f"SELECT * FROM readings WHERE {FILTER}"),
    "filtered_star_readings": r(f"""
SELECT machine_id, reading_ts, operation_mode, efficiency_status, temperature_c, vibration_hz, power_kw,
       speed_uph, error_rate_pct, defect_rate_pct, latency_ms, packet_loss_pct, pm_score
FROM readings WHERE {FILTER}"""),
    "filtered_star_machine": r("""
SELECT machine_id, reading_ts, operation_mode, efficiency_status, temperature_c, vibration_hz, power_kw,
       speed_uph, error_rate_pct, defect_rate_pct, latency_ms, packet_loss_pct, pm_score
FROM readings
WHERE reading_ts >= TIMESTAMP '2024-01-02' AND reading_ts <= TIMESTAMP '2024-01-29'
  AND machine_id = 7 AND operation_mode = 'Active'"""),
    "filtered_readings_machine_mode": r("""
SELECT * FROM readings
WHERE reading_ts >= TIMESTAMP '2024-01-02' AND reading_ts <= TIMESTAMP '2024-01-29'
  AND machine_id = 7 AND operation_mode = 'Active'"""),
    "data_status": r("""
SELECT COUNT(*) AS n_rows, CASE WHEN COUNT(*) > 0 THEN 'ok' ELSE 'no data' END AS status
FROM readings"""),
    "production_series": r("SELECT machine_id, reading_ts, speed_uph FROM readings"),
    "error_series": r("SELECT machine_id, reading_ts, error_rate_pct FROM readings"),
    "production_series_15min": r("""
SELECT machine_id, time_bucket(INTERVAL 15 MINUTE, reading_ts) AS bucket_start,
       AVG(speed_uph) AS speed_uph, COUNT(*) AS n_readings
FROM readings GROUP BY 1, 2"""),
    "means_by_mode": r("""
SELECT operation_mode, AVG(speed_uph) AS avg_speed, AVG(error_rate_pct) AS avg_error_rate
FROM readings GROUP BY 1"""),
    "means_by_machine": r("""
SELECT machine_id, AVG(speed_uph) AS avg_speed, AVG(error_rate_pct) AS avg_error_rate
FROM readings GROUP BY 1"""),
    "score_histogram": r("""
, f AS (SELECT pm_score FROM readings WHERE pm_score IS NOT NULL),
b AS (SELECT MIN(pm_score) AS lo, MAX(pm_score) AS hi FROM f),
x AS (SELECT CAST(CASE WHEN hi = lo THEN 0
                       ELSE LEAST(FLOOR((pm_score - lo) / ((hi - lo) / 30)), 29) END AS INTEGER) AS bin, lo, hi
      FROM f, b)
SELECT bin, lo + bin * ((hi - lo) / 30) AS bin_start,
       CASE WHEN hi = lo THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 30) END AS bin_end, COUNT(*) AS n
FROM x GROUP BY bin, lo, hi"""),
    "filter_domains": r(f"""
, {MODE_CODES}
SELECT 'date' AS kind, 0 AS code, CAST(CAST(MIN(reading_ts) AS DATE) AS VARCHAR) AS label FROM readings
UNION ALL SELECT 'date', 1, CAST(CAST(MAX(reading_ts) AS DATE) AS VARCHAR) FROM readings
UNION ALL SELECT DISTINCT 'machine', machine_id, CAST(machine_id AS VARCHAR) FROM readings
UNION ALL SELECT 'mode', mode_code, operation_mode FROM codes"""),
    "means_long": r("""
, w AS (SELECT operation_mode, AVG(speed_uph) AS avg_speed, AVG(error_rate_pct) AS avg_error_rate
        FROM readings GROUP BY 1)
SELECT operation_mode, measure, value
FROM (UNPIVOT w ON avg_speed, avg_error_rate INTO NAME measure VALUE value)"""),
}

_AVAIL = f"AVG(CASE WHEN {ACTIVE} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
_OEE = (f"{_AVAIL} * (AVG(speed_uph) / NULLIF(MAX(speed_uph), 0)) * (1 - AVG(defect_rate_pct) / 100)")

KPI_SQL = {
    "fleet_oee": r(f"""
SELECT ROUND(AVG(oee), 9) AS fleet_oee, COUNT(*) AS n_machines
FROM (SELECT machine_id, {_OEE} AS oee FROM readings GROUP BY machine_id)"""),
    "failure_rate": r("""
SELECT AVG(CASE WHEN error_rate_pct > 5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS failure_rate,
       CAST(COUNT_IF(error_rate_pct > 5) AS BIGINT) AS n_failures, COUNT(*) AS n_readings
FROM readings"""),
    "mtbf": r("""
, s AS (SELECT machine_id, MIN(epoch_us(reading_ts)) AS t0, MAX(epoch_us(reading_ts)) AS t1, COUNT(*) AS n
        FROM readings WHERE error_rate_pct > 5 GROUP BY machine_id)
SELECT CAST(SUM(t1 - t0) AS DOUBLE) / NULLIF(CAST(3600000000 AS DOUBLE) * SUM(n - 1), 0) AS mtbf_hours,
       CAST(SUM(n - 1) AS BIGINT) AS n_gaps
FROM s"""),
    "mtbf_by_machine": r("""
SELECT machine_id, COUNT(*) AS n_failures,
       CASE WHEN COUNT(*) > 1 THEN CAST(MAX(epoch_us(reading_ts)) - MIN(epoch_us(reading_ts)) AS DOUBLE)
            / (CAST(3600000000 AS DOUBLE) * (COUNT(*) - 1)) END AS mtbf_hours
FROM readings WHERE error_rate_pct > 5 GROUP BY machine_id"""),
    "kpi_trend": r(f"""
, a AS (SELECT MAX(epoch_us(reading_ts)) AS anchor FROM readings),
j AS (SELECT r.*, epoch_us(reading_ts) AS tk,
        CASE WHEN epoch_us(reading_ts) > anchor - 7200000000 THEN 'recent'
             WHEN epoch_us(reading_ts) > anchor - 14400000000 THEN 'previous' END AS tag
      FROM readings r, a),
per AS (SELECT tag, machine_id, {_AVAIL} AS a_, AVG(speed_uph) / NULLIF(MAX(speed_uph), 0) AS p_,
          1 - AVG(defect_rate_pct) / 100 AS q_, COUNT(*) AS n, COUNT_IF(error_rate_pct > 5) AS nf,
          MIN(CASE WHEN error_rate_pct > 5 THEN tk END) AS t0, MAX(CASE WHEN error_rate_pct > 5 THEN tk END) AS t1
        FROM j WHERE tag IS NOT NULL GROUP BY 1, 2),
pt AS (SELECT tag, AVG(a_ * p_ * q_) AS oee, SUM(nf) / SUM(n) AS failure_rate,
         SUM(t1 - t0) / NULLIF(SUM(CASE WHEN nf > 0 THEN nf - 1 END), 0) / 3600000000.0 AS mtbf_hours
       FROM per GROUP BY 1),
l AS (SELECT tag, 'oee' AS kpi, oee AS value FROM pt
      UNION ALL SELECT tag, 'failure_rate', failure_rate FROM pt
      UNION ALL SELECT tag, 'mtbf_hours', mtbf_hours FROM pt),
w AS (SELECT kpi, ROUND(MAX(CASE WHEN tag = 'recent' THEN value END), 9) AS recent,
             ROUND(MAX(CASE WHEN tag = 'previous' THEN value END), 9) AS previous
      FROM l GROUP BY kpi),
c AS (SELECT *, ROUND((recent - previous) / NULLIF(previous, 0), 9) AS relative_change FROM w)
SELECT kpi, recent, previous, relative_change,
       CASE WHEN relative_change IS NULL THEN 'unknown' WHEN ABS(relative_change) <= 0.05 THEN 'stable'
            WHEN relative_change > 0 THEN 'rising' ELSE 'falling' END AS trend
FROM c ORDER BY kpi"""),
}

N2 = "format('{{:,.2f}}', round(CAST({} AS DECIMAL(28, 10)), 2))"
PLAIN2 = "format('{{:.2f}}', round(CAST({} AS DECIMAL(28, 10)), 2))"
PY2 = "format('{{:,.2f}}', {})"

DISPLAY_SQL = {
    "hourly_display": r(f"""
SELECT CAST(hour(reading_ts) AS INTEGER) AS hour, {N2.format('AVG(speed_uph)')} AS avg_speed,
       {N2.format('AVG(error_rate_pct)')} || '%' AS avg_error_rate, COUNT(*) AS n_readings
FROM readings GROUP BY 1"""),
    "hourly_plain_display": r(f"""
SELECT CAST(hour(reading_ts) AS INTEGER) AS hour, {PLAIN2.format('AVG(speed_uph)')} AS avg_speed,
       {PLAIN2.format('AVG(error_rate_pct)')} || '%' AS avg_error_rate, COUNT(*) AS n_readings
FROM readings GROUP BY 1"""),
    "oee_two_factor_display": r(f"""
, a AS (SELECT machine_id, AVG(speed_uph) / NULLIF(MAX(speed_uph), 0) AS speed_ratio,
               1 - AVG(defect_rate_pct) / 100 AS quality FROM readings GROUP BY machine_id)
SELECT machine_id, {PY2.format('speed_ratio')} AS speed_ratio, {PY2.format('quality * 100')} || '%' AS quality,
       {PY2.format('speed_ratio * quality')} AS oee
FROM a"""),
    "efficiency_display": r(f"""
SELECT machine_id, efficiency_status, {PY2.format('AVG(speed_uph)')} AS avg_speed,
       {PY2.format('AVG(error_rate_pct)')} || '%' AS avg_error_rate, COUNT(*) AS n_readings
FROM readings GROUP BY machine_id, efficiency_status"""),
}

MODEL_SQL = {
    "label_codes": r("""
SELECT kind, label, CAST(DENSE_RANK() OVER (PARTITION BY kind ORDER BY label) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT 'operation_mode' AS kind, operation_mode AS label FROM readings
      UNION ALL SELECT DISTINCT 'efficiency_status', efficiency_status FROM readings)"""),
    "failure_label": r("""
SELECT reading_id, CASE WHEN pm_score > 0.8 OR error_rate_pct > 10 THEN 1 ELSE 0 END AS failure_label
FROM readings"""),
    "split_flags": r("""
SELECT reading_id, substr(md5('42:' || CAST(reading_id AS VARCHAR)), 1, 8) >= 'cccccccc' AS is_test
FROM readings"""),
    "incomplete_inputs": d("""
SELECT reading_id,
  CASE WHEN temperature_c IS NOT NULL AND vibration_hz IS NOT NULL AND power_kw IS NOT NULL
        AND speed_uph IS NOT NULL AND error_rate_pct IS NOT NULL AND defect_rate_pct IS NOT NULL
        AND latency_ms IS NOT NULL AND packet_loss_pct IS NOT NULL AND pm_score IS NOT NULL
        AND operation_mode IS NOT NULL THEN 'ready' ELSE 'incomplete' END AS status
FROM conv"""),
    # what every scored row must satisfy: answered when complete (a known label, a percentage), else not
    **{name: d("""
SELECT reading_id, CASE WHEN ok THEN 'scored' ELSE 'incomplete' END AS status, ok AS answered
FROM (SELECT reading_id, (temperature_c IS NOT NULL AND vibration_hz IS NOT NULL AND power_kw IS NOT NULL
        AND speed_uph IS NOT NULL AND error_rate_pct IS NOT NULL AND defect_rate_pct IS NOT NULL
        AND latency_ms IS NOT NULL AND packet_loss_pct IS NOT NULL AND pm_score IS NOT NULL
        AND operation_mode IS NOT NULL) AS ok FROM conv)""") for name in ("efficiency_scores", "failure_scores")},
    # share of the test rows as a floor for the label accuracy; the failure label is a function of two features
    "model_metrics": r("""
SELECT * FROM (VALUES ('efficiency', 'accuracy', TRUE), ('efficiency', 'f1', TRUE), ('failure', 'area_under_roc', TRUE))
  t(model, metric, plausible)"""),
}
