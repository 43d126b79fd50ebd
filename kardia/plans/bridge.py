"""Map the driver's generic tables onto the health data model.

Everything is derived by Spark from the given tables, so the work of every
registered query grows with them:

* ``events`` -> records (type from ``event_type``, subject ``user_id``,
  start ``ts`` at whole seconds, end ``start + floor(value)`` minutes) which
  then go through the real routing / typing path into ``vitals``,
  ``activity`` …; ``signup`` events are workout sessions (36 h long), each
  user's events form a GPS route, ``view`` events are sleep intervals;
* ``embeddings`` -> ECG recordings (64 samples at 15 Hz);
* ``orders`` + ``lineitem`` -> nested workouts (attributes + child statistics).

The round-trip helpers render rows as export text (XML / CSV / GPX) so the
parsers can be checked against the original columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kardia.manifest import SUBJECT, Manifest, default_manifest
from kardia.operators.routing import route_records, wide_projection, with_content_id, with_normalised_dates

# FIXED VALUES (bridge): event type -> HealthKit record type.
EVENT_TYPE_MAP = {
    "click": "HKQuantityTypeIdentifierHeartRate",
    "view": "HKQuantityTypeIdentifierHeartRateVariabilitySDNN",
    "error": "HKQuantityTypeIdentifierRestingHeartRate",
    "purchase": "HKQuantityTypeIdentifierActiveEnergyBurned",
    "signup": "HKQuantityTypeIdentifierStepCount",
}
INTEGER_EVENT_TYPES = ("signup",)
WORKOUT_HOURS = 36
ECG_RATE_HZ = 15.0
EXPORT_OFFSET = "-0500"          # records are rendered in a non-UTC offset
EXPORT_OFFSET_HOURS = -5


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lit_map(d: dict) -> Column:
    """Literal map as one SQL expression (one JVM call)."""
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in d.items()) + ")")


def event_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``ts`` as a UTC TIMESTAMP at whole seconds."""
    e = load(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value",
                    F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))


def value_text(event_type: Column, value: Column) -> Column:
    """Value as export text: integers for count types, else 2-decimal text."""
    return F.when(event_type.isin(*INTEGER_EVENT_TYPES), F.floor(value).cast("bigint").cast("string")) \
            .otherwise(value.cast("decimal(12,2)").cast("string"))


def export_date_text(ts: Column) -> Column:
    """TIMESTAMP -> export layout in the bridge's offset (``… -0500``)."""
    local = F.timestamp_add("HOUR", F.lit(EXPORT_OFFSET_HOURS), ts)
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(" " + EXPORT_OFFSET))


def event_end(ts: Column, value: Column) -> Column:
    return F.timestamp_add("MINUTE", F.floor(value).cast("int"), ts)


def event_records(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """events as parsed ``<Record>`` attribute rows (the scan's output shape)."""
    e = event_base(spark, sf_dir)
    return e.select(
        "event_id", *keep,
        F.col("user_id").cast("string").alias(SUBJECT),
        F.try_element_at(_lit_map(EVENT_TYPE_MAP), F.col("event_type")).alias("type"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source_name"),
        export_date_text(F.col("ts")).alias("creation_date_raw"),
        export_date_text(F.col("ts")).alias("start_date_raw"),
        export_date_text(event_end(F.col("ts"), F.col("value"))).alias("end_date_raw"),
        value_text(F.col("event_type"), F.col("value")).alias("value"),
    )


def routed_records(spark: SparkSession, sf_dir: str, manifest: Manifest | None = None,
                   with_id: bool = True) -> DataFrame:
    m = manifest or default_manifest()
    routed = with_normalised_dates(route_records(event_records(spark, sf_dir), m))
    return with_content_id(routed) if with_id else routed.withColumn("uuid", F.lit(None).cast("string"))


def metric_table(spark: SparkSession, sf_dir: str, table: str, manifest: Manifest | None = None,
                 with_id: bool = False) -> DataFrame:
    """A typed metric table (vitals, activity, sleep …) built from events."""
    m = manifest or default_manifest()
    return wide_projection(routed_records(spark, sf_dir, m, with_id), m.table(table),
                           extra_cols=("event_id",))


_STORES: dict[tuple[str, str], str] = {}


def stored_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vitals as a stored table: appended once per application and input to a store, then read from it."""
    from kardia.plans.batches import path_exists
    from kardia.plans.store import TableStore
    from kardia.session import scratch_dir
    m = default_manifest()
    made = (spark.sparkContext.applicationId, sf_dir)
    if made not in _STORES or not path_exists(spark, f"{_STORES[made]}/vitals"):
        root = scratch_dir(spark, "vitals-store")
        TableStore(spark, root, m).append_new("vitals", metric_table(spark, sf_dir, "vitals", m, with_id=True).drop("event_id"), order_cols=["creation_date"])
        _STORES[made] = root
    return TableStore(spark, _STORES[made], m).read("vitals")


def sleep_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sleep intervals: ``view`` events, stage ``event_id % 7`` (6 = unknown)."""
    e = event_base(spark, sf_dir).filter(F.col("event_type") == "view")
    return e.select(
        F.col("user_id").cast("string").alias(SUBJECT), "event_id",
        (F.col("event_id") % 7).alias("sleep_stage"),
        F.col("ts").alias("start_date"), event_end(F.col("ts"), F.col("value")).alias("end_date"))


def workouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions: ``signup`` events, from the full hour, 36 h long, with a route file per day.

    The session id is the start text and the file is named by the day, so both
    repeat across people; equal starts of one person collapse (K7)."""
    e = event_base(spark, sf_dir).filter(F.col("event_type") == "signup")
    start = F.date_trunc("hour", F.col("ts"))
    return e.select(
        F.col("user_id").cast("string").alias(SUBJECT),
        F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("session_id"),
        start.alias("start_date"),
        F.timestamp_add("HOUR", F.lit(WORKOUT_HOURS), start).alias("end_date"),
        route_file(F.col("ts")).alias("route_file")).distinct()


def route_file(ts: Column) -> Column:
    return F.concat(F.lit("route_"), F.date_format(ts, "yyyy-MM-dd"), F.lit(".gpx"))


def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPS points: one route per user and day, ordered by (timestamp, point_seq)."""
    e = event_base(spark, sf_dir)
    return e.select(
        F.col("user_id").cast("string").alias(SUBJECT),
        route_file(F.col("ts")).alias("file_name"),
        F.col("event_id").alias("point_seq"),
        F.col("ts").alias("timestamp"),
        (F.lit(37.0) + F.col("value") / 1000).alias("latitude"),
        (F.lit(-122.0) + (F.col("event_id") % 1000) / 1000).alias("longitude"),
        F.col("value").alias("elevation"),
        (F.col("value") / 10).alias("speed_ms"))


def ecg_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ECG signals: each embedding is a recording sampled at 15 Hz."""
    em = load(spark, sf_dir, "embeddings")
    return em.select(
        F.col("vec_id"),
        F.concat(F.lit("ecg_"), F.col("vec_id").cast("string"), F.lit(".csv")).alias("file_name"),
        F.transform("embedding", lambda x: x.cast("double")).alias("samples"),
        F.lit(ECG_RATE_HZ).alias("sample_rate_hz"),
        F.col("label"))


# ---- round-trip renderers ---------------------------------------------------

def _attr(name: str, value: Column, escape: bool = False) -> Column:
    """`` name="value"`` (XML-escaped if asked); NULL value -> attribute omitted."""
    if escape:
        value = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "&", "&amp;"), '"', "&quot;"), "<", "&lt;")
    return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), value, F.lit('"'))).otherwise(F.lit(""))


def record_chunks(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Render parsed-record rows as the text chunks the ``<Record`` split yields
    (self-closing tags; every third record carries a MetadataEntry child and
    spans lines)."""
    attrs = F.concat(
        _attr("type", F.col("type")), _attr("sourceName", F.col("source_name"), escape=True),
        _attr("creationDate", F.col("creation_date_raw")), _attr("startDate", F.col("start_date_raw")),
        _attr("endDate", F.col("end_date_raw")), _attr("value", F.col("value"), escape=True))
    tail = F.when(F.col("event_id") % 3 == 0,
                  F.lit('>\n  <MetadataEntry key="HKMetadataKeyHeartRateMotionContext" value="0"/>\n </Record>\n '))\
            .otherwise(F.lit("/>\n "))
    body = F.concat(attrs, tail)
    return records.select("event_id", SUBJECT, *keep, body.alias("chunk"))
