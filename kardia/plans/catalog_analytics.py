"""Registered analytic queries: buckets, trends, table queries, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kardia.manifest import default_manifest
from kardia.operators import aggregate as agg
from kardia.operators import query as qry
from kardia.plans import bridge
from kardia.plans.registry import register
from kardia.plans.sql import R, STORED, VITALS, ts_text
from kardia.session import scratch_dir

# Demo aggregate settings for vitals (the shipped manifest declares none).
VITALS_AGGS = {"heart_rate": "avg", "resting_hr": "min", "hrv_sdnn": "max", "hr_recovery": "count"}
ALL_AGGS = {"heart_rate": "avg", "hrv_sdnn": "sum", "resting_hr": "min", "vo2_max": "max",
            "oxygen_sat": "count"}
RANGE = ("2024-01-08", "2024-01-20T12:00:00Z")


def r4(df: DataFrame) -> DataFrame:
    """Round double columns to 4 places (sums are order dependent); tie-safe
    like the oracle side (see ``registry.TIE_EPS``)."""
    from kardia.plans.registry import TIE_EPS
    return df.select(*[(F.round(F.col(f.name) + TIE_EPS, 4) + F.lit(0.0)).alias(f.name)
                       if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])


def ts_str(df: DataFrame) -> DataFrame:
    """Timestamps as 'yyyy-MM-dd HH:mm:ss' text for engine-neutral comparison."""
    return df.select(*[F.date_format(F.col(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name)
                       if f.dataType.typeName() in ("timestamp", "timestamp_ntz") else F.col(f.name)
                       for f in df.schema.fields])


def vitals(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.metric_table(spark, sf, "vitals")


_BUCKET_SQL = """WITH {r}, {v}
SELECT strftime(start_date, '{fmt}') AS time_bucket,
       round(avg(heart_rate), 4) AS heart_rate, min(resting_hr) AS resting_hr,
       max(hrv_sdnn) AS hrv_sdnn, count(NULL::DOUBLE) AS hr_recovery
FROM V {where} GROUP BY 1"""


def _bucket_sql(fmt: str, where: str = "") -> str:
    return _BUCKET_SQL.format(r=R, v=VITALS, fmt=fmt, where=where)


@register("bucket_hour", _bucket_sql("%Y-%m-%dT%H:00:00Z"))
def bucket_hour(spark, sf):
    return r4(agg.bucket_aggregate(vitals(spark, sf), "hour", aggs=VITALS_AGGS))


@register("bucket_day", _bucket_sql("%Y-%m-%d"))
def bucket_day(spark, sf):
    return r4(agg.bucket_aggregate(vitals(spark, sf), "day", aggs=VITALS_AGGS))


@register("bucket_month", _bucket_sql("%Y-%m"))
def bucket_month(spark, sf):
    return r4(agg.bucket_aggregate(vitals(spark, sf), "month", aggs=VITALS_AGGS))


@register("bucket_range", f"""WITH {R}, {VITALS}, {STORED}
SELECT strftime(start_date, '%Y-%m-%d') AS time_bucket,
       round(avg(heart_rate), 4) AS heart_rate, min(resting_hr) AS resting_hr,
       max(hrv_sdnn) AS hrv_sdnn, count(NULL::DOUBLE) AS hr_recovery
FROM VD WHERE start_date >= TIMESTAMP '2024-01-08 00:00:00' AND start_date <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1""")
def bucket_range(spark, sf):
    """F1 with a range, on the stored table: the range reaches its files."""
    return r4(agg.bucket_aggregate(bridge.stored_vitals(spark, sf), "day", aggs=VITALS_AGGS, start=RANGE[0], end=RANGE[1]))


@register("bucket_all_aggs", f"""WITH {R}, {VITALS}
SELECT strftime(start_date, '%Y-%m-%d') AS time_bucket,
       round(avg(heart_rate), 4) AS heart_rate, round(sum(hrv_sdnn), 4) AS hrv_sdnn,
       min(resting_hr) AS resting_hr, max(NULL::DOUBLE) AS vo2_max, count(NULL::DOUBLE) AS oxygen_sat
FROM V GROUP BY 1""")
def bucket_all_aggs(spark, sf):
    return r4(agg.bucket_aggregate(vitals(spark, sf), "day", aggs=ALL_AGGS))


@register("trends", f"""WITH {R}, {VITALS}, {STORED}
SELECT round(avg(heart_rate), 4) AS heart_rate_avg, min(heart_rate) AS heart_rate_min, max(heart_rate) AS heart_rate_max,
       round(avg(resting_hr), 4) AS resting_hr_avg, min(resting_hr) AS resting_hr_min, max(resting_hr) AS resting_hr_max,
       round(avg(hrv_sdnn), 4) AS hrv_sdnn_avg, min(hrv_sdnn) AS hrv_sdnn_min, max(hrv_sdnn) AS hrv_sdnn_max,
       avg(NULL::DOUBLE) AS hr_recovery_avg, min(NULL::DOUBLE) AS hr_recovery_min, max(NULL::DOUBLE) AS hr_recovery_max,
       avg(NULL::DOUBLE) AS vo2_max_avg, min(NULL::DOUBLE) AS vo2_max_min, max(NULL::DOUBLE) AS vo2_max_max,
       avg(NULL::DOUBLE) AS oxygen_sat_avg, min(NULL::DOUBLE) AS oxygen_sat_min, max(NULL::DOUBLE) AS oxygen_sat_max,
       avg(NULL::DOUBLE) AS resp_rate_avg, min(NULL::DOUBLE) AS resp_rate_min, max(NULL::DOUBLE) AS resp_rate_max
FROM VD WHERE start_date >= TIMESTAMP '2024-01-08 00:00:00' AND start_date <= TIMESTAMP '2024-01-20 12:00:00'""")
def trends(spark, sf):
    """F3 on the stored table."""
    m = default_manifest()
    return r4(agg.biometric_trends(bridge.stored_vitals(spark, sf), m.table("vitals"), start=RANGE[0], end=RANGE[1]))


@register("trends_by_user", f"""WITH {R}, {VITALS}
SELECT subject_id, round(avg(heart_rate), 4) AS heart_rate_avg, min(heart_rate) AS heart_rate_min,
       max(heart_rate) AS heart_rate_max, round(avg(hrv_sdnn), 4) AS hrv_sdnn_avg
FROM V GROUP BY subject_id""")
def trends_by_user(spark, sf):
    m = default_manifest()
    out = agg.biometric_trends(vitals(spark, sf), m.table("vitals"), subject_cols=["subject_id"])
    return r4(out.select("subject_id", "heart_rate_avg", "heart_rate_min", "heart_rate_max", "hrv_sdnn_avg"))


# ---- table queries ---------------------------------------------------------

_VITALS_ROW = """SELECT event_id, subject_id, {st} AS start_date, {en} AS end_date,
       heart_rate, resting_hr, hrv_sdnn FROM V""".format(st=ts_text("start_date"), en=ts_text("end_date"))


def _vitals_rows(spark, sf):
    return vitals(spark, sf).select("event_id", "subject_id", "start_date", "end_date",
                                    "heart_rate", "resting_hr", "hrv_sdnn")


@register("table_query_topk", f"""WITH {R}, {VITALS}
{_VITALS_ROW} ORDER BY V.start_date DESC, event_id DESC LIMIT 100""")
def table_query_topk(spark, sf):
    return ts_str(qry.table_query(_vitals_rows(spark, sf), sort="start_date", limit=100,
                                  tie_break=["event_id"]))


_STORED_ROW = """SELECT subject_id, {st} AS start_date, {en} AS end_date, heart_rate, resting_hr, hrv_sdnn FROM VD""".format(
    st=ts_text("start_date"), en=ts_text("end_date"))


def _stored_rows(spark, sf):
    return bridge.stored_vitals(spark, sf).select("subject_id", "start_date", "end_date", "heart_rate", "resting_hr", "hrv_sdnn")


@register("table_query_range", f"""WITH {R}, {VITALS}, {STORED}
{_STORED_ROW} WHERE VD.start_date >= TIMESTAMP '2024-01-08 00:00:00' AND VD.start_date <= TIMESTAMP '2024-01-20 12:00:00'""")
def table_query_range(spark, sf):
    """Q2 on the stored table."""
    return ts_str(qry.table_query(_stored_rows(spark, sf), sort="start_date", limit=None,
                                  start=RANGE[0], end=RANGE[1]))


@register("date_prefix_filter", f"""WITH {R}, {VITALS}, {STORED}
{_STORED_ROW} WHERE CAST(VD.start_date AS DATE) = DATE '2024-01-15'""")
def date_prefix_filter(spark, sf):
    """Q6 on the stored table."""
    return ts_str(qry.date_prefix_filter(_stored_rows(spark, sf), "2024-01-15"))


@register("rows_to_json", f"""WITH {R}, {VITALS}
SELECT json_object('event_id', event_id, 'subject_id', subject_id, 'start_date', {ts_text("start_date")}, 'end_date', {ts_text("end_date")},
                   'heart_rate', heart_rate, 'resting_hr', resting_hr, 'hrv_sdnn', hrv_sdnn)::VARCHAR AS json FROM V""")
def rows_to_json(spark, sf):
    """Every column of the rows, doubles and NULLs included."""
    return qry.rows_to_json(ts_str(_vitals_rows(spark, sf)))


@register("csv_export_rows", f"""WITH {R}, {VITALS}
SELECT 'event_id,subject_id,start_date,end_date,heart_rate,resting_hr,hrv_sdnn' AS line
UNION ALL SELECT concat_ws(',', CAST(event_id AS VARCHAR), subject_id, {ts_text("start_date")}, {ts_text("end_date")},
       {", ".join(f"coalesce(regexp_replace(CAST({c} AS VARCHAR), '[.]0$', ''), '')" for c in ("heart_rate", "resting_hr", "hrv_sdnn"))}) FROM V""")
def csv_export_rows(spark, sf):
    """The rows as the export has written them, header included."""
    path = scratch_dir(spark, "csv")
    qry.export_csv(ts_str(_vitals_rows(spark, sf)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@register("table_counts", f"""WITH {R}
SELECT 'vitals' AS table_name, count(*) AS row_count FROM R WHERE event_type IN ('click','view','error')
UNION ALL SELECT 'activity', count(*) FROM R WHERE event_type IN ('purchase','signup')
UNION ALL SELECT 'body_metrics', 0
UNION ALL SELECT 'route_points', count(*) FROM R
UNION ALL SELECT 'ecg_recordings', count(*) FROM embeddings""")
def table_counts(spark, sf):
    m = default_manifest()
    tables = {"vitals": bridge.metric_table(spark, sf, "vitals", m),
              "activity": bridge.metric_table(spark, sf, "activity", m),
              "body_metrics": bridge.metric_table(spark, sf, "body_metrics", m),
              "route_points": bridge.route_points(spark, sf),
              "ecg_recordings": bridge.ecg_recordings(spark, sf)}
    return qry.table_counts(tables)


@register("bucket_day_by_user", f"""WITH {R}, {VITALS}
SELECT subject_id, strftime(start_date, '%Y-%m-%d') AS time_bucket,
       round(avg(heart_rate), 4) AS heart_rate, min(resting_hr) AS resting_hr,
       max(hrv_sdnn) AS hrv_sdnn, count(NULL::DOUBLE) AS hr_recovery
FROM V GROUP BY 1, 2""")
def bucket_day_by_user(spark, sf):
    """F1 set-based: one bucket series per subject (the reference serves one)."""
    return r4(agg.bucket_aggregate(vitals(spark, sf), "day", aggs=VITALS_AGGS, subject_cols=["subject_id"]))
