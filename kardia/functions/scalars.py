"""Scalar column functions: geo distance, zones, labels, ids, casts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kardia.manifest import spark_type

EARTH_RADIUS_M = 6_371_000.0

# FIXED VALUES: heart-rate zone labels with their upper bounds in percent of
# max heart rate (half-open; exactly 90 % is the top zone).
HR_ZONES = (
    ("Z1_Recovery", 60.0),
    ("Z2_Aerobic", 70.0),
    ("Z3_Steady", 80.0),
    ("Z4_Threshold", 90.0),
    ("Z5_Anaerobic", None),
)
ZONE_NAMES = tuple(z for z, _ in HR_ZONES)

# FIXED VALUES: sleep stage codes and their labels.
SLEEP_STAGES = {0: "In Bed", 1: "Asleep", 2: "Awake", 3: "Core", 4: "Deep", 5: "REM"}
SLEEP_UNKNOWN = "Unknown"
# FIXED VALUES: the HealthKit category value names exported for sleep stages.
SLEEP_SYMBOLS = {
    "HKCategoryValueSleepAnalysisInBed": 0,
    "HKCategoryValueSleepAnalysisAsleepUnspecified": 1,
    "HKCategoryValueSleepAnalysisAsleep": 1,
    "HKCategoryValueSleepAnalysisAwake": 2,
    "HKCategoryValueSleepAnalysisAsleepCore": 3,
    "HKCategoryValueSleepAnalysisAsleepDeep": 4,
    "HKCategoryValueSleepAnalysisAsleepREM": 5,
}

# FIXED VALUES: recovery status bands (score strictly above the bound).
RECOVERY_BANDS = (("Optimal", 80), ("Good", 50), ("Strained", 30))
RECOVERY_FLOOR = "Recovery Needed"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres (R = 6,371 km)."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    dphi = F.radians(lat2 - lat1)
    dlmb = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(EARTH_RADIUS_M) * (F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)))


def hr_zone(hr, max_hr) -> Column:
    """Zone label of ``hr / max_hr * 100`` (keeps the reference operation order)."""
    pct = _c(hr) / (max_hr if isinstance(max_hr, Column) else F.lit(float(max_hr))) * F.lit(100.0)
    expr = None
    for name, upper in HR_ZONES:
        if upper is None:
            expr = expr.otherwise(F.lit(name))
        elif expr is None:
            expr = F.when(pct < upper, F.lit(name))
        else:
            expr = expr.when(pct < upper, F.lit(name))
    return expr


def sleep_stage_label(stage) -> Column:
    expr = F.when(F.lit(False), F.lit(None))
    for code, label in SLEEP_STAGES.items():
        expr = expr.when(_c(stage) == code, F.lit(label))
    return expr.otherwise(F.lit(SLEEP_UNKNOWN))


def sleep_stage_code(text) -> Column:
    """Stage text (digits, or a symbolic category value) -> integer code."""
    c = _c(text)
    expr = F.when(F.lit(False), F.lit(None).cast("bigint"))
    for sym, code in SLEEP_SYMBOLS.items():
        expr = expr.when(c == sym, F.lit(code).cast("bigint"))
    return F.coalesce(c.try_cast("bigint"), expr)


def interval_seconds(start, end) -> Column:
    """Whole seconds between two timestamps (truncated; negatives kept)."""
    return F.timestamp_diff("SECOND", _c(start), _c(end))


def recovery_status(score) -> Column:
    s = _c(score)
    expr = None
    for label, lower in RECOVERY_BANDS:
        expr = F.when(s > lower, F.lit(label)) if expr is None else expr.when(s > lower, F.lit(label))
    return expr.otherwise(F.lit(RECOVERY_FLOOR))


def clamp_round(x) -> Column:
    """Clamp to 0..100, round half away from zero, INT."""
    return F.round(F.greatest(F.least(_c(x), F.lit(100.0)), F.lit(0.0))).cast("int")


def content_id(table: Column, column: Column, start_text: Column, end_text: Column,
               value_text: Column) -> Column:
    """Hex SHA-256 of table‖column‖start‖end‖value; a missing part hashes as ''."""
    parts = [F.coalesce(p, F.lit("")) for p in (table, column, start_text, end_text, value_text)]
    return F.sha2(F.concat(*parts), 256)


def typed_cast(text, data_type: str) -> Column:
    """Text value -> manifest type; bad or empty text -> NULL (never raises)."""
    c = _c(text)
    dt = data_type.upper()
    if dt in ("TEXT", "BLOB"):
        return c
    if dt == "DATETIME":
        from kardia.functions.dates import parse_any_date
        return parse_any_date(c)
    # Java's number parser also takes a type letter at the end ("1d", "12f"); those are not numbers here
    return F.when(~F.trim(c).rlike("[dDfFlL]$"), F.trim(c)).try_cast(spark_type(dt))


def base_name(path) -> Column:
    """Last path component (text after the final '/')."""
    return F.regexp_extract(_c(path), r"([^/]+)/*$", 1)
