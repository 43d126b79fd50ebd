"""Registered signal / session queries: routes, workouts, intensity, sleep, recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from kardia.functions import scalars as S
from kardia.operators import intervals, query, routes, sessions
from kardia.plans import bridge
from kardia.plans.catalog_analytics import r4, ts_str
from kardia.plans.registry import register
from kardia.plans.sql import POINTS, R, STORED, VITALS, WORKOUTS, haversine, ts_text

AS_OF = "2024-01-30"
MAX_HR = 190.0

# ---- routes -----------------------------------------------------------------

_SEG_SQL = f"""WITH {R}, {POINTS},
S AS (SELECT subject_id, file_name, point_seq, latitude, longitude, elevation, timestamp, speed_ms,
        lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon, lag(elevation) OVER w AS pele
      FROM P WINDOW w AS (PARTITION BY subject_id, file_name ORDER BY timestamp, point_seq)),
G AS (SELECT subject_id, file_name, point_seq, latitude, longitude, elevation, timestamp, speed_ms,
        coalesce({haversine('plat', 'plon', 'latitude', 'longitude')}, 0.0) AS segment_m,
        CASE WHEN pele IS NOT NULL AND elevation > pele THEN elevation - pele ELSE 0.0 END AS gain_m
      FROM S)"""


@register("route_segments", _SEG_SQL + """
SELECT subject_id, file_name, point_seq, round(segment_m, 4) AS segment_m, round(gain_m, 4) AS gain_m FROM G""")
def route_segments(spark, sf):
    seg = routes.route_segments(bridge.route_points(spark, sf))
    return r4(seg.select("subject_id", "file_name", "point_seq", "segment_m", "gain_m"))


@register("haversine", f"""WITH {R}, {POINTS}
SELECT point_seq, round({haversine('47.3769', '8.5417', 'latitude', 'longitude')}, 4) AS dist_m FROM P""")
def haversine_q(spark, sf):
    p = bridge.route_points(spark, sf)
    return r4(p.select("point_seq", S.haversine_m(F.lit(47.3769), F.lit(8.5417),
                                                  F.col("latitude"), F.col("longitude")).alias("dist_m")))


@register("route_distance", _SEG_SQL + """
SELECT subject_id, file_name, count(*) AS point_count, round(sum(segment_m) / 1000.0, 4) AS distance_km FROM G GROUP BY 1, 2""")
def route_distance(spark, sf):
    t = routes.route_totals(bridge.route_points(spark, sf))
    return r4(t.select("subject_id", "file_name", "point_count", "distance_km"))


@register("route_elevation_gain", _SEG_SQL + """
SELECT subject_id, file_name, round(sum(gain_m), 4) AS elevation_gain_m FROM G GROUP BY 1, 2""")
def route_elevation_gain(spark, sf):
    t = routes.route_totals(bridge.route_points(spark, sf))
    return r4(t.select("subject_id", "file_name", "elevation_gain_m"))


@register("workout_route_join", f"""WITH {R}, {WORKOUTS}, {POINTS},
T AS (SELECT subject_id, file_name, count(*) AS point_count, min(timestamp) AS first_time, max(timestamp) AS last_time
      FROM P GROUP BY 1, 2)
SELECT W.subject_id, W.session_id, W.route_file, coalesce(T.point_count, 0) AS point_count,
       {ts_text('T.first_time')} AS first_time, {ts_text('T.last_time')} AS last_time
FROM W LEFT JOIN T ON W.subject_id = T.subject_id AND W.route_file = T.file_name""")
def workout_route_join(spark, sf):
    t = routes.route_totals(bridge.route_points(spark, sf))
    j = routes.workout_routes(bridge.workouts(spark, sf), t)
    return ts_str(j.select("subject_id", "session_id", "route_file", "point_count", "first_time", "last_time"))


@register("workout_details", _SEG_SQL + f""", {WORKOUTS.replace('W AS', 'WK AS')},
T AS (SELECT subject_id, file_name, count(*) AS point_count, sum(segment_m) / 1000.0 AS km, sum(gain_m) AS gain FROM G GROUP BY 1, 2)
SELECT WK.subject_id, WK.session_id, {ts_text('WK.start_date')} AS start_date, {ts_text('WK.end_date')} AS end_date, WK.route_file,
       coalesce(T.point_count, 0) AS point_count, round(coalesce(T.km, 0.0), 4) AS calculated_distance_km,
       round(coalesce(T.gain, 0.0), 4) AS calculated_elevation_gain_m
FROM WK LEFT JOIN T ON WK.subject_id = T.subject_id AND WK.route_file = T.file_name""")
def workout_details(spark, sf):
    t = routes.route_totals(bridge.route_points(spark, sf))
    j = routes.workout_routes(bridge.workouts(spark, sf), t)
    return r4(ts_str(j.select("subject_id", "session_id", "start_date", "end_date", "route_file", "point_count",
                              "calculated_distance_km", "calculated_elevation_gain_m")))


@register("workout_points", _SEG_SQL + f""", {WORKOUTS.replace('W AS', 'WK AS')},
N AS (SELECT *, row_number() OVER (PARTITION BY subject_id, file_name ORDER BY timestamp, point_seq) AS sequence FROM G)
SELECT N.subject_id, WK.session_id, N.sequence, {ts_text('N.timestamp')} AS timestamp, round(latitude, 4) AS latitude,
       round(longitude, 4) AS longitude, round(elevation, 4) AS elevation, round(speed_ms, 4) AS speed_ms,
       round(segment_m, 4) AS segment_m, round(gain_m, 4) AS gain_m
FROM N JOIN WK ON N.subject_id = WK.subject_id AND N.file_name = WK.route_file""")
def workout_points(spark, sf):
    """E1 + Q8: the ordered points of every workout's route."""
    return r4(ts_str(routes.workout_points(bridge.workouts(spark, sf), bridge.route_points(spark, sf))))


LOOKUP_ID = "2024-01-15 12:00:00"


@register("workout_lookup", f"""WITH {R}, {WORKOUTS}
SELECT session_id, subject_id, {ts_text('start_date')} AS start_date, {ts_text('end_date')} AS end_date, route_file
FROM W WHERE session_id = '{LOOKUP_ID}'""")
def workout_lookup(spark, sf):
    """Q7: point lookup of one start among all sessions; people share it."""
    hit = query.lookup(bridge.workouts(spark, sf), "session_id", LOOKUP_ID)
    return ts_str(hit.select("session_id", "subject_id", "start_date", "end_date", "route_file"))


@register("recording_lookup", """SELECT vec_id, 'ecg_' || CAST(vec_id AS VARCHAR) || '.csv' AS file_name, label
FROM embeddings WHERE vec_id = 7""")
def recording_lookup(spark, sf):
    """Q7: point lookup of one recording by its file name."""
    return query.lookup(bridge.ecg_recordings(spark, sf), "file_name", "ecg_7.csv").select("vec_id", "file_name", "label")


# ---- intensity (range join) ----------------------------------------------------

_HR = f"""H AS (SELECT subject_id, event_id, start_date AS t, heart_rate,
  CASE WHEN heart_rate / 190.0 * 100.0 < 60 THEN 'Z1_Recovery' WHEN heart_rate / 190.0 * 100.0 < 70 THEN 'Z2_Aerobic'
       WHEN heart_rate / 190.0 * 100.0 < 80 THEN 'Z3_Steady' WHEN heart_rate / 190.0 * 100.0 < 90 THEN 'Z4_Threshold'
       ELSE 'Z5_Anaerobic' END AS zone
  FROM V WHERE heart_rate > 0)"""


def _samples(spark, sf):
    return bridge.metric_table(spark, sf, "vitals").filter(F.col("heart_rate").isNotNull())


@register("workout_hr_range_join", f"""WITH {R}, {VITALS}, {WORKOUTS}, {_HR}
SELECT W.subject_id, W.session_id, count(*) AS n_samples, round(sum(H.heart_rate), 4) AS hr_sum
FROM W JOIN H ON H.subject_id = W.subject_id AND H.t BETWEEN W.start_date AND W.end_date GROUP BY 1, 2""")
def workout_hr_range_join(spark, sf):
    """A person's samples within their sessions, as pairs."""
    w = bridge.workouts(spark, sf).select("subject_id", "session_id", "start_date", "end_date")
    h = _samples(spark, sf).filter(F.col("heart_rate") > 0).select("subject_id", F.col("start_date").alias("t"), "heart_rate")
    pairs = intervals.range_join(w, h, "start_date", "end_date", "t", bin_unit="day")
    return r4(pairs.groupBy("subject_id", "session_id").agg(F.count(F.lit(1)).alias("n_samples"),
                                                            F.sum("heart_rate").alias("hr_sum")))


@register("workout_hr_range_join_by_user", f"""WITH {R}, {VITALS}, {WORKOUTS}, {_HR}
SELECT W.subject_id, W.session_id, count(H.t) AS n_samples, round(coalesce(sum(H.heart_rate), 0.0), 4) AS hr_sum
FROM W LEFT JOIN H ON H.subject_id = W.subject_id AND H.t BETWEEN W.start_date AND W.end_date GROUP BY 1, 2""")
def workout_hr_range_join_by_user(spark, sf):
    """E2 without pairs: counts and sums per session from running totals; sessions without samples stay."""
    w = bridge.workouts(spark, sf).select("subject_id", "session_id", "start_date", "end_date")
    h = _samples(spark, sf).filter(F.col("heart_rate") > 0).select(
        "subject_id", F.col("start_date").alias("t"), F.col("heart_rate").cast("decimal(18,2)").alias("hr"))
    found = intervals.interval_point_counts(w, h, "session_id", "start_date", "end_date", "t", value_col="hr")
    return r4(found.select("subject_id", "session_id", F.col("n").alias("n_samples"), F.col("total").cast("double").alias("hr_sum")))


def _zone_sql() -> str:
    zones = ", ".join(f"count(H.t) FILTER (WHERE H.zone = '{z}') AS {z}" for z in S.ZONE_NAMES)
    return f"""WITH {R}, {VITALS}, {WORKOUTS}, {_HR},
Z AS (SELECT W.subject_id, W.session_id, count(H.t) AS sample_count, CAST(190.0 AS DOUBLE) AS max_hr_used, {zones}
FROM W LEFT JOIN H ON H.subject_id = W.subject_id AND H.t BETWEEN W.start_date AND W.end_date GROUP BY 1, 2)"""


@register("hr_zone_histogram", _zone_sql() + " SELECT * FROM Z")
def hr_zone_histogram(spark, sf):
    """zones of each session, with the profile's maximum heart rate."""
    return sessions.hr_zone_histogram(bridge.workouts(spark, sf), _samples(spark, sf))


@register("hr_zone_histogram_by_user", _zone_sql() + " SELECT subject_id, " + ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("sample_count", *S.ZONE_NAMES)) + " FROM Z GROUP BY 1")
def hr_zone_histogram_by_user(spark, sf):
    """zones of all sessions of a person."""
    z = sessions.hr_zone_histogram(bridge.workouts(spark, sf), _samples(spark, sf))
    return z.groupBy("subject_id").agg(*[F.sum(c).alias(c) for c in ("sample_count", *S.ZONE_NAMES)])


@register("hr_zone_label", f"""WITH {R}, {VITALS}, {_HR} SELECT event_id, zone FROM H""")
def hr_zone_label(spark, sf):
    v = _samples(spark, sf).filter(F.col("heart_rate") > 0)
    return v.select("event_id", S.hr_zone(F.col("heart_rate"), MAX_HR).alias("zone"))


# ---- sleep -------------------------------------------------------------------------

_SLEEP = """SL AS (SELECT CAST(user_id AS VARCHAR) AS subject_id, event_id, event_id % 7 AS code, ts AS s, te AS e,
  CASE event_id % 7 WHEN 0 THEN 'In Bed' WHEN 1 THEN 'Asleep' WHEN 2 THEN 'Awake' WHEN 3 THEN 'Core'
    WHEN 4 THEN 'Deep' WHEN 5 THEN 'REM' ELSE 'Unknown' END AS stage
  FROM R WHERE event_type = 'view')"""


@register("sleep_breakdown", f"""WITH {R}, {_SLEEP}
SELECT subject_id, strftime(s, '%Y-%m-%d') AS date, stage, sum(CAST(date_diff('second', s, e) AS DOUBLE)) AS seconds
FROM SL GROUP BY 1, 2, 3""")
def sleep_breakdown(spark, sf):
    return sessions.sleep_breakdown(bridge.sleep_table(spark, sf), subject_cols=["subject_id"])


@register("sleep_total_hours", f"""WITH {R}, {_SLEEP}
SELECT subject_id, strftime(s, '%Y-%m-%d') AS date,
       round(sum(date_diff('second', s, e)) / 3600.0, 4) AS total_sleep_hours,
       round(coalesce(sum(date_diff('second', s, e)) FILTER (WHERE stage IN ('Asleep','Core','Deep','REM')), 0) / 3600.0, 4) AS asleep_hours
FROM SL GROUP BY 1, 2""")
def sleep_total_hours(spark, sf):
    return r4(sessions.sleep_total_hours(bridge.sleep_table(spark, sf), subject_cols=["subject_id"]))


@register("sleep_stage_label", f"""WITH {R}, {_SLEEP} SELECT event_id, stage FROM SL""")
def sleep_stage_label(spark, sf):
    s = bridge.sleep_table(spark, sf)
    return s.select("event_id", S.sleep_stage_label(F.col("sleep_stage")).alias("stage"))


@register("interval_seconds", f"""WITH {R}, {_SLEEP} SELECT event_id, date_diff('second', s, e) AS seconds FROM SL""")
def interval_seconds(spark, sf):
    s = bridge.sleep_table(spark, sf)
    return s.select("event_id", S.interval_seconds(F.col("start_date"), F.col("end_date")).alias("seconds"))


@register("date_prefix_sleep", f"""WITH {R}, {_SLEEP}
SELECT subject_id, stage, sum(CAST(date_diff('second', s, e) AS DOUBLE)) AS seconds FROM SL
WHERE CAST(s AS DATE) = DATE '2024-01-15' GROUP BY 1, 2""")
def date_prefix_sleep(spark, sf):
    """Q6 + F6: one day's breakdown (the reference's per-date call), all subjects."""
    out = sessions.sleep_breakdown(bridge.sleep_table(spark, sf), day="2024-01-15", subject_cols=["subject_id"])
    return out.select("subject_id", "stage", "seconds")


# ---- recovery ------------------------------------------------------------------------

def _recovery_sql() -> str:
    return f"""WITH {R}, {VITALS}, {STORED},
A AS (SELECT subject_id,
  coalesce(avg(hrv_sdnn) FILTER (WHERE hrv_sdnn > 0), 0.0) AS hb,
  coalesce(avg(hrv_sdnn) FILTER (WHERE hrv_sdnn > 0 AND start_date >= TIMESTAMP '2024-01-29 00:00:00'), 0.0) AS hc,
  coalesce(avg(resting_hr) FILTER (WHERE resting_hr > 0), 0.0) AS rb,
  coalesce(avg(resting_hr) FILTER (WHERE resting_hr > 0 AND start_date >= TIMESTAMP '2024-01-29 00:00:00'), 0.0) AS rc
  FROM (SELECT subject_id, start_date, CASE WHEN start_date >= TIMESTAMP '2024-01-23 00:00:00' THEN hrv_sdnn END AS hrv_sdnn,
               CASE WHEN start_date >= TIMESTAMP '2024-01-23 00:00:00' THEN resting_hr END AS resting_hr FROM VD) GROUP BY 1),
B AS (SELECT *, CASE WHEN rc > rb AND rb > 0 THEN (CASE WHEN hb > 0 THEN hc / hb * 100.0 ELSE 0.0 END) - (rc - rb) * 5.0
                     ELSE (CASE WHEN hb > 0 THEN hc / hb * 100.0 ELSE 0.0 END) END AS raw FROM A),
C AS (SELECT *, CAST(round(greatest(least(raw, 100.0), 0.0)) AS INTEGER) AS score FROM B)
SELECT subject_id, score AS recovery_score,
  CASE WHEN score > 80 THEN 'Optimal' WHEN score > 50 THEN 'Good' WHEN score > 30 THEN 'Strained' ELSE 'Recovery Needed' END AS status,
  round(hb, 4) AS hrv_baseline, round(hc, 4) AS hrv_current, round(rb, 4) AS rhr_baseline, round(rc, 4) AS rhr_current
FROM C"""


@register("recovery_score", _recovery_sql())
def recovery_score(spark, sf):
    """F4 on the stored table."""
    v = bridge.stored_vitals(spark, sf)
    return r4(sessions.recovery_score(v, AS_OF, subject_cols=["subject_id"]))


@register("recovery_daily", f"""WITH {R}, {VITALS},
D AS (SELECT subject_id, CAST(start_date AS DATE) AS day, date_diff('day', DATE '1970-01-01', CAST(start_date AS DATE)) AS dn,
  sum(hrv_sdnn) FILTER (WHERE hrv_sdnn > 0) AS hs, count(hrv_sdnn) FILTER (WHERE hrv_sdnn > 0) AS hcnt,
  sum(resting_hr) FILTER (WHERE resting_hr > 0) AS rs, count(resting_hr) FILTER (WHERE resting_hr > 0) AS rcnt
  FROM V GROUP BY 1, 2, 3),
X AS (SELECT subject_id, day,
  CASE WHEN sum(hcnt) OVER w7 > 0 THEN sum(hs) OVER w7 / sum(hcnt) OVER w7 ELSE 0.0 END AS hb,
  CASE WHEN sum(hcnt) OVER w1 > 0 THEN sum(hs) OVER w1 / sum(hcnt) OVER w1 ELSE 0.0 END AS hc,
  CASE WHEN sum(rcnt) OVER w7 > 0 THEN sum(rs) OVER w7 / sum(rcnt) OVER w7 ELSE 0.0 END AS rb,
  CASE WHEN sum(rcnt) OVER w1 > 0 THEN sum(rs) OVER w1 / sum(rcnt) OVER w1 ELSE 0.0 END AS rc
  FROM D WINDOW w7 AS (PARTITION BY subject_id ORDER BY dn RANGE BETWEEN 7 PRECEDING AND CURRENT ROW),
                w1 AS (PARTITION BY subject_id ORDER BY dn RANGE BETWEEN 1 PRECEDING AND CURRENT ROW)),
B AS (SELECT *, CASE WHEN rc > rb AND rb > 0 THEN (CASE WHEN hb > 0 THEN hc / hb * 100.0 ELSE 0.0 END) - (rc - rb) * 5.0
                     ELSE (CASE WHEN hb > 0 THEN hc / hb * 100.0 ELSE 0.0 END) END AS raw FROM X),
C AS (SELECT *, CAST(round(greatest(least(raw, 100.0), 0.0)) AS INTEGER) AS score FROM B)
SELECT subject_id, strftime(day, '%Y-%m-%d') AS as_of, score AS recovery_score,
  CASE WHEN score > 80 THEN 'Optimal' WHEN score > 50 THEN 'Good' WHEN score > 30 THEN 'Strained' ELSE 'Recovery Needed' END AS status,
  round(hb, 4) AS hrv_baseline, round(hc, 4) AS hrv_current,
  round(rb, 4) AS rhr_baseline, round(rc, 4) AS rhr_current
FROM C""")
def recovery_daily(spark, sf):
    v = bridge.metric_table(spark, sf, "vitals")
    return r4(sessions.recovery_daily(v, subject_cols=["subject_id"]))


@register("recovery_status", f"""WITH {R}
SELECT event_id, CASE WHEN floor(value) > 80 THEN 'Optimal' WHEN floor(value) > 50 THEN 'Good'
  WHEN floor(value) > 30 THEN 'Strained' ELSE 'Recovery Needed' END AS status FROM R""")
def recovery_status(spark, sf):
    e = bridge.event_base(spark, sf)
    return e.select("event_id", S.recovery_status(F.floor("value")).alias("status"))


@register("clamp_round", f"""WITH {R}
SELECT event_id, CAST(round(greatest(least(value - 100.0, 100.0), 0.0)) AS INTEGER) AS score FROM R""")
def clamp_round(spark, sf):
    e = bridge.event_base(spark, sf)
    return e.select("event_id", S.clamp_round(F.col("value") - 100.0).alias("score"))
