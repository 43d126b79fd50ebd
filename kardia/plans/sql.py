"""Shared SQL fragments for the DuckDB oracles (mirrors :mod:`kardia.plans.bridge`)."""

# events at whole seconds, value as the 2-decimal number the export carries
R = """R AS (SELECT event_id, user_id, event_type, date_trunc('second', ts) AS ts, value,
       CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS v,
       date_trunc('second', ts) + to_minutes(CAST(floor(value) AS BIGINT)) AS te
FROM events)"""

HK_TYPE = """CASE event_type
  WHEN 'click' THEN 'HKQuantityTypeIdentifierHeartRate'
  WHEN 'view' THEN 'HKQuantityTypeIdentifierHeartRateVariabilitySDNN'
  WHEN 'error' THEN 'HKQuantityTypeIdentifierRestingHeartRate'
  WHEN 'purchase' THEN 'HKQuantityTypeIdentifierActiveEnergyBurned'
  WHEN 'signup' THEN 'HKQuantityTypeIdentifierStepCount' END"""

TABLE_OF = """CASE WHEN event_type IN ('click','view','error') THEN 'vitals'
  WHEN event_type IN ('purchase','signup') THEN 'activity' END"""

COLUMN_OF = """CASE event_type WHEN 'click' THEN 'heart_rate' WHEN 'view' THEN 'hrv_sdnn'
  WHEN 'error' THEN 'resting_hr' WHEN 'purchase' THEN 'active_cals' WHEN 'signup' THEN 'step_count' END"""

VALUE_TEXT = """CASE WHEN event_type = 'signup' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
  ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END"""


def iso(expr: str) -> str:
    """Normalised UTC text of a timestamp expression."""
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S+00:00')"


def ts_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


# vitals as the bridge types them
VITALS = """V AS (SELECT event_id, CAST(user_id AS VARCHAR) AS subject_id, ts AS start_date, te AS end_date,
       CASE WHEN event_type = 'click' THEN v END AS heart_rate,
       CASE WHEN event_type = 'error' THEN v END AS resting_hr,
       CASE WHEN event_type = 'view' THEN v END AS hrv_sdnn
FROM R WHERE event_type IN ('click','view','error'))"""

# as the store keeps them: one row per subject and content
STORED = """VD AS (SELECT DISTINCT subject_id, start_date, end_date, heart_rate, resting_hr, hrv_sdnn FROM V)"""

# sessions start on the hour, so people share session ids, and one person's equal starts collapse
WORKOUTS = """W AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS subject_id,
       strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS session_id,
       date_trunc('hour', ts) AS start_date, date_trunc('hour', ts) + INTERVAL 36 HOUR AS end_date,
       'route_' || strftime(ts, '%Y-%m-%d') || '.gpx' AS route_file
FROM R WHERE event_type = 'signup')"""

POINTS = """P AS (SELECT CAST(user_id AS VARCHAR) AS subject_id,
       'route_' || strftime(ts, '%Y-%m-%d') || '.gpx' AS file_name, event_id AS point_seq,
       ts AS timestamp, 37.0 + value / 1000 AS latitude, -122.0 + (event_id % 1000) / 1000 AS longitude,
       value AS elevation, value / 10 AS speed_ms
FROM R)"""


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(6371000.0 * (2.0 * atan2(sqrt({a}), sqrt(1.0 - {a}))))"
