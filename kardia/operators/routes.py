"""E1, G1, G2, F10, H1 — route segments, totals, and the workout ⟕ route join.

Totals are computed once per route file (aggregate), then joined to the
workouts that reference the file — never one copy of the points per workout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kardia.functions.scalars import haversine_m
from kardia.manifest import SUBJECT
from kardia.operators.intervals import Cols, join_keys, subject_keys
from kardia.operators.prefix import in_ranges, with_previous_row, with_running_sums

POINT_VALUES = ["latitude", "longitude", "elevation"]


def route_segments(points: DataFrame, file_col: str = "file_name", time_col: str = "timestamp",
                   tie_cols: Cols = ("point_seq",), subject_cols: Cols | None = None) -> DataFrame:
    """G1 + G2 + H1: within a subject's route file, each point with its predecessor's position, the segment
    length in metres and the positive elevation delta (0 for the first point)."""
    subject_cols = subject_keys(subject_cols, points)
    return _segments(in_ranges(points, [*subject_cols, file_col], [time_col, *tie_cols]), [*subject_cols, file_col]).select(*points.columns, *SEGMENT_COLS)


SEGMENT_COLS = ["prev_latitude", "prev_longitude", "prev_elevation", "segment_m", "gain_m"]


def _segments(ranged: DataFrame, keys: list[str]) -> DataFrame:
    """Add the segment columns to points in ranges."""
    x = with_previous_row(ranged, keys, F.struct(*POINT_VALUES), "prev")
    p = F.col("prev")
    seg = F.when(p.isNotNull(), haversine_m(p["latitude"], p["longitude"], F.col("latitude"), F.col("longitude")))
    gain = F.when(p.isNotNull() & (F.col("elevation") > p["elevation"]), F.col("elevation") - p["elevation"])
    return x.select(*ranged.columns,
                    p["latitude"].alias("prev_latitude"), p["longitude"].alias("prev_longitude"),
                    p["elevation"].alias("prev_elevation"),
                    F.coalesce(seg, F.lit(0.0)).alias("segment_m"),
                    F.coalesce(gain, F.lit(0.0)).alias("gain_m"))


def route_totals(points: DataFrame, file_col: str = "file_name", time_col: str = "timestamp",
                 tie_cols: Cols = ("point_seq",), subject_cols: Cols | None = None) -> DataFrame:
    """per subject and route file — point count, distance (km), elevation gain (m),
    first and last point time."""
    subject_cols = subject_keys(subject_cols, points)
    seg = route_segments(points, file_col, time_col, tie_cols, subject_cols)
    # plain min/max of the time keep this a (map-side combined) hash aggregate
    return seg.groupBy(*subject_cols, file_col).agg(
        F.count(F.lit(1)).alias("point_count"),
        (F.sum("segment_m") / 1000.0).alias("distance_km"),
        F.sum("gain_m").alias("elevation_gain_m"),
        F.min(time_col).alias("first_time"),
        F.max(time_col).alias("last_time"))


def workout_routes(workouts: DataFrame, totals: DataFrame, route_col: str = "route_file",
                   file_col: str = "file_name", subject_cols: Cols | None = None) -> DataFrame:
    """Workouts ⟕ route totals on the subject (NULL equals NULL) and ``route_file = file_name``.

    A workout without a route keeps its row with NULL route fields; a route
    file without points reports zero points and 0.0 totals."""
    subject_cols = subject_keys(subject_cols, workouts, totals)
    t = totals.withColumnsRenamed({file_col: "_route_key", **{c: f"_k{c}" for c in subject_cols}})
    on = workouts[route_col] == t["_route_key"]
    for c in subject_cols:
        on = on & workouts[c].eqNullSafe(t[f"_k{c}"])
    j = workouts.join(t, on, "left")
    has_route = F.col(route_col).isNotNull()
    return j.select(
        *workouts.columns,
        F.when(has_route, F.coalesce("point_count", F.lit(0))).alias("point_count"),
        F.when(has_route, F.coalesce("distance_km", F.lit(0.0))).alias("calculated_distance_km"),
        F.when(has_route, F.coalesce("elevation_gain_m", F.lit(0.0))).alias("calculated_elevation_gain_m"),
        "first_time", "last_time")


def workout_points(workouts: DataFrame, points: DataFrame, route_col: str = "route_file", session_col: str = "session_id",
                   file_col: str = "file_name", time_col: str = "timestamp", tie_cols: Cols = ("point_seq",),
                   subject_cols: Cols | None = None) -> DataFrame:
    """E1 + Q8: the points of every workout's route as a long relation — subject, session,
    sequence number (from 1, in time order), time, position, elevation, speed, segment length and gain.

    The sequence number is a running count over ranges of points, so a route is never one task."""
    subject_cols = subject_keys(subject_cols, workouts, points)
    keys = [*subject_cols, file_col]
    ranged = in_ranges(points, keys, [time_col, *tie_cols])
    numbered = with_running_sums(_segments(ranged, keys), keys, {"sequence": F.lit(1).cast("long")})
    w = workouts.filter(F.col(route_col).isNotNull()).select(
        session_col, F.col(route_col).alias("_route"), *[F.col(c).alias(f"_w{c}") for c in subject_cols])
    on = numbered[file_col] == w["_route"]
    for c in subject_cols:
        on = on & numbered[c].eqNullSafe(w[f"_w{c}"])
    return numbered.join(w, on).select(*subject_cols, session_col, "sequence", time_col, "latitude", "longitude", "elevation", "speed_ms", "segment_m", "gain_m")


def route_points_of(points: DataFrame, file_name: str, file_col: str = "file_name",
                    time_col: str = "timestamp", tie_cols: Cols = ("point_seq",),
                    subject: str | None = None) -> DataFrame:
    """Q7 + Q8: the points of one subject's route file in time order (the details view
    of a single workout) — a pushed-down filter plus a sort, never a collected
    array. In a table with subjects, no ``subject`` means the rows without one."""
    if subject_keys(None, points):
        points = points.filter(F.col(SUBJECT).eqNullSafe(F.lit(subject).cast("string")))
    return (points.filter(F.col(file_col) == F.lit(file_name))
            .orderBy(F.asc_nulls_first(time_col), *[F.asc(c) for c in tie_cols]))
