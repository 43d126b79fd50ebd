"""Registered ingest-side queries: scans, routing, ids, typing, dedupe, schema."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from kardia.functions.dates import normalize_date
from kardia.functions.scalars import typed_cast
from kardia.manifest import default_manifest, load_manifest
from kardia.operators import dedupe, routing
from kardia.plans import bridge
from kardia.plans.catalog_analytics import r4, ts_str
from kardia.plans.registry import register
from kardia.plans.sql import COLUMN_OF, HK_TYPE, R, TABLE_OF, VALUE_TEXT, VITALS, iso, ts_text
from kardia.plans.store import TableStore
from kardia.session import scratch_dir
from kardia.sources import records as rec

# ---- A1 record scan ---------------------------------------------------------

FILES = 8  # of a rendered export


@register("record_scan", f"""WITH {R}
SELECT {HK_TYPE} AS type, 'user-' || CAST(user_id AS VARCHAR) AS source_name,
       {iso('ts')} AS creation_date, {iso('ts')} AS start_date, {iso('te')} AS end_date,
       {VALUE_TEXT} AS value
FROM R""")
def record_scan(spark: SparkSession, sf: str):
    """A1: the records of export files of several splits, read a tag a row."""
    path = f"{scratch_dir(spark, 'records')}/export"
    chunks = bridge.record_chunks(bridge.event_records(spark, sf).repartition(FILES))
    chunks.select(F.concat(F.lit("<Record"), F.col("chunk"))).write.text(path)
    parsed, _ = rec.split_quarantine(rec.scan_records(spark, path))
    return parsed.select("type", "source_name",
                         normalize_date(F.col("creation_date_raw")).alias("creation_date"),
                         normalize_date(F.col("start_date_raw")).alias("start_date"),
                         normalize_date(F.col("end_date_raw")).alias("end_date"), "value")


@register("quarantine_split", f"""WITH {R}
SELECT user_id, CASE WHEN event_type = 'error' THEN 'bad' ELSE 'good' END AS part, count(*) AS n FROM R GROUP BY 1, 2""")
def quarantine_split(spark, sf):
    """Error events are written with a broken start tag (no closing '>');
    they land in quarantine, the rest parse."""
    path = f"{scratch_dir(spark, 'broken')}/export"
    recs = bridge.event_records(spark, sf, keep=("event_type",)).repartition(FILES)
    chunks = bridge.record_chunks(recs, keep=("event_type",))
    broken = F.when(F.col("event_type") == "error", F.regexp_replace(F.col("chunk"), ">", "")) \
              .otherwise(F.col("chunk"))
    chunks.select(F.concat(F.lit("<Record"), broken)).write.text(path)
    good, bad = rec.split_quarantine(rec.scan_records(spark, path))
    user = F.regexp_extract("raw", 'sourceName="user-([0-9]+)', 1)
    parts = good.select(F.regexp_extract("source_name", "user-([0-9]+)", 1).cast("long").alias("user_id"), F.lit("good").alias("part")).unionByName(
        bad.select(user.cast("long").alias("user_id"), F.lit("bad").alias("part")))
    return parts.groupBy("user_id", "part").agg(F.count("*").alias("n"))


# ---- B1–B3 routing ----------------------------------------------------------


@register("metric_routing", f"""WITH {R}
SELECT event_id, {TABLE_OF} AS table_name, {COLUMN_OF} AS column_name FROM R""")
def metric_routing(spark, sf):
    routed = routing.route_records(bridge.event_records(spark, sf), default_manifest())
    return routed.select("event_id", "table_name", "column_name")


@register("table_fanout_counts", f"""WITH {R}
SELECT {TABLE_OF} AS table_name, count(*) AS mapped FROM R GROUP BY 1""")
def table_fanout_counts(spark, sf):
    routed = routing.route_records(bridge.event_records(spark, sf), default_manifest())
    return routed.groupBy("table_name").agg(F.count(F.lit(1)).alias("mapped"))


@register("wide_projection", f"""WITH {R}
SELECT event_id, CASE WHEN event_type = 'purchase' THEN v END AS active_cals,
       CASE WHEN event_type = 'signup' THEN CAST(floor(value) AS BIGINT) END AS step_count,
       CAST(NULL AS DOUBLE) AS dist_walk_run, CAST(NULL AS BIGINT) AS flights_climbed
FROM R WHERE event_type IN ('purchase','signup')""")
def wide_projection(spark, sf):
    act = bridge.metric_table(spark, sf, "activity")
    return act.select("event_id", "active_cals", "step_count", "dist_walk_run", "flights_climbed")


# ---- B8–B10 normalisation -----------------------------------------------------


@register("normalize_date", f"""WITH {R}
SELECT event_id, {iso('ts')} AS start_norm, 'not a date ' || CAST(event_id AS VARCHAR) AS bad_norm FROM R""")
def normalize_date_q(spark, sf):
    recs = bridge.event_records(spark, sf)
    return recs.select("event_id", normalize_date(F.col("start_date_raw")).alias("start_norm"),
                       normalize_date(F.concat(F.lit("not a date "), F.col("event_id").cast("string")))
                       .alias("bad_norm"))


@register("content_id", f"""WITH {R}
SELECT event_id, sha256({TABLE_OF} || {COLUMN_OF} || {iso('ts')} || {iso('te')} || {VALUE_TEXT}) AS uuid
FROM R""")
def content_id(spark, sf):
    return bridge.routed_records(spark, sf).select("event_id", "uuid")


@register("typed_cast", f"""WITH {R}
SELECT event_id, TRY_CAST({VALUE_TEXT} AS DOUBLE) AS as_real,
       CASE WHEN regexp_full_match({VALUE_TEXT}, '-?[0-9]+') THEN CAST({VALUE_TEXT} AS BIGINT) END AS as_integer,
       {VALUE_TEXT} AS as_text, CAST(NULL AS DOUBLE) AS empty_real
FROM R""")
def typed_cast_q(spark, sf):
    recs = bridge.event_records(spark, sf)
    return recs.select("event_id", typed_cast(F.col("value"), "REAL").alias("as_real"),
                       typed_cast(F.col("value"), "INTEGER").alias("as_integer"),
                       typed_cast(F.col("value"), "TEXT").alias("as_text"),
                       typed_cast(F.lit(""), "REAL").alias("empty_real"))


DERIVED_MANIFEST = """
[tables.vitals]
columns = [
  { name = "heart_rate", hk_type = "HKQuantityTypeIdentifierHeartRate", data_type = "REAL", aggregate = "avg" },
  { name = "effort_score", data_type = "REAL", expression = "heart_rate * 0.1", aggregate = "avg" },
]
"""


@register("derived_column", f"""WITH {R}
SELECT event_id, round(v, 4) AS heart_rate, round(v * 0.1, 4) AS effort_score
FROM R WHERE event_type = 'click'""")
def derived_column(spark, sf):
    m = load_manifest(DERIVED_MANIFEST)
    t = m.table("vitals")
    rows = bridge.metric_table(spark, sf, "vitals", m)
    return r4(routing.with_generated_columns(rows, t).select("event_id", "heart_rate", "effort_score"))


_OLD_MANIFEST = """
[tables.vitals]
columns = [
  { name = "heart_rate", hk_type = "HKQuantityTypeIdentifierHeartRate", data_type = "REAL" },
  { name = "resting_hr", hk_type = "HKQuantityTypeIdentifierRestingHeartRate", data_type = "REAL" },
]
"""


@register("schema_evolution", f"""WITH {R}, {VITALS}
SELECT DISTINCT subject_id, {ts_text('start_date')} AS start_date, {ts_text('end_date')} AS end_date, round(heart_rate, 4) AS heart_rate,
       round(resting_hr, 4) AS resting_hr, round(hrv_sdnn, 4) AS hrv_sdnn FROM V
WHERE start_date >= TIMESTAMP '2024-01-15 00:00:00' OR hrv_sdnn IS NULL""")
def schema_evolution(spark, sf):
    """The first half is stored under a manifest without ``hrv_sdnn``, the second under the
    present one; read under the present one, the added column is NULL in the old files."""
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    root = scratch_dir(spark, "evolution")
    for m, half in ((load_manifest(_OLD_MANIFEST), F.col("start_date") < cut), (default_manifest(), F.col("start_date") >= cut)):
        TableStore(spark, root, m).append_new("vitals", bridge.metric_table(spark, sf, "vitals", m, with_id=True).filter(half), order_cols=["creation_date"])
    v = TableStore(spark, root, default_manifest()).read("vitals")
    return r4(ts_str(v.select("subject_id", "start_date", "end_date", "heart_rate", "resting_hr", "hrv_sdnn")))


# ---- C1 / E4 / A7 dedupe and incremental -------------------------------------


@register("dedupe_first_wins", f"""WITH {R}
SELECT user_id, event_type, event_id, {iso('ts')} AS first_ts FROM R
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def dedupe_first_wins(spark, sf):
    e = bridge.event_base(spark, sf).select("user_id", "event_type", "ts", "event_id")
    out = dedupe.dedupe_first_wins(e, ["user_id", "event_type"], order_cols=["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id",
                      F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("first_ts"))


@register("idempotent_append", f"""WITH {R}, K AS (
  SELECT user_id, event_type, CAST(ts AS DATE) AS day, event_id, ts FROM R
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) = 1)
SELECT user_id, event_type, strftime(day, '%Y-%m-%d') AS day, event_id FROM K
WHERE NOT EXISTS (SELECT 1 FROM R WHERE R.ts < TIMESTAMP '2024-01-15 00:00:00'
  AND R.user_id = K.user_id AND R.event_type = K.event_type AND CAST(R.ts AS DATE) = K.day)""")
def idempotent_append(spark, sf):
    """Target = first half (already stored); batch = whole month (re-ingest).
    Key (user, type, day); only keys absent from the target are appended."""
    e = bridge.event_base(spark, sf).select(
        "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id")
    target = e.filter(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp"))
    rows = dedupe.idempotent_rows(e, target, ["user_id", "event_type", "day"], order_cols=["ts", "event_id"])
    return rows.select("user_id", "event_type", "day", "event_id")


@register("new_files_only", f"""WITH {R}, F AS (
  SELECT DISTINCT 'route_' || CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d') || '.gpx' AS file_name,
         ts < TIMESTAMP '2024-01-15 00:00:00' AS done FROM R)
SELECT DISTINCT file_name FROM F WHERE NOT EXISTS (SELECT 1 FROM F d WHERE d.done AND d.file_name = F.file_name)""")
def new_files_only(spark, sf):
    """Candidate files (one route per user-day) minus files already imported
    (those of the first half of the month) — a left anti join on file name."""
    e = bridge.event_base(spark, sf)
    files = e.select(F.concat(F.lit("route_"), F.col("user_id").cast("string"), F.lit("_"),
                              F.date_format("ts", "yyyyMMdd"), F.lit(".gpx")).alias("file_name"), "ts")
    done = files.filter(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp")).select("file_name")
    return dedupe.new_rows_only(files.select("file_name").distinct(), done, ["file_name"])
