"""Registered element-source queries: workouts, summaries, GPX, child-row extraction.

Orders render as ``<Workout>`` elements whose children come from their line
items (pre-aggregated to the last line per return flag, so an element holds
at most one statistic per type — bounded by the number of types, not by the
data); the parse back must give the original columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kardia.functions.scalars import base_name
from kardia.manifest import default_manifest
from kardia.plans import bridge
from kardia.plans.batches import delete_path
from kardia.plans.catalog_analytics import ts_str
from kardia.plans.registry import register
from kardia.session import dropping_shuffles, scratch_dir
from kardia.sources import elements as el
from kardia.sources import tags

# FIXED VALUES (bridge): line-item return flag -> workout statistic type,
# line status -> workout metadata key.
FLAG_STAT = {"A": "HKQuantityTypeIdentifierActiveEnergyBurned",
             "N": "HKQuantityTypeIdentifierBasalEnergyBurned",
             "R": "HKQuantityTypeIdentifierDistanceWalkingRunning"}
FILES = 8  # of a rendered export, at least
FILE_WORKOUTS = 500_000  # of a file of it at most: some 350 MB, several splits
STATUS_META = {"F": "HKAverageMETs", "O": "HKWeatherTemperature"}


def _lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _q(v: Column) -> Column:
    return F.concat(F.lit('"'), v, F.lit('"'))


def _dec(v: Column, scale: int = 2) -> Column:
    return v.cast(f"decimal(18,{scale})").cast("string")


def order_start(o: Column, key: Column) -> Column:
    return F.timestamp_add("SECOND", key.cast("int"), o.cast("timestamp"))


def export_text(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000"))


def last_stat_per_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Last line (by line number, ties by quantity) per (order, flag)."""
    li = bridge.load(spark, sf, "lineitem")
    return (li.groupBy("l_orderkey", "l_returnflag")
            .agg(F.max(F.struct("l_linenumber", "l_quantity")).alias("w"))
            .select("l_orderkey", "l_returnflag", F.col("w.l_quantity").alias("qty")))


def workout_parts(spark: SparkSession, sf: str) -> DataFrame:
    """What a workout's text is made of, a row per order: the texts of its attributes and of its statistics (``kids``)."""
    o = bridge.load(spark, sf, "orders")
    stats = last_stat_per_flag(spark, sf).select(
        "l_orderkey", F.concat(F.lit("<WorkoutStatistics type="),
                               _q(F.try_element_at(_lit_map(FLAG_STAT), F.col("l_returnflag"))),
                               F.lit(" sum="), _q(_dec(F.col("qty"))), F.lit(' unit="kcal"/>')).alias("x"))
    children = stats.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("x")), "\n  ").alias("kids"))
    st = order_start(F.col("o_orderdate"), F.col("o_orderkey"))
    return o.join(children, o["o_orderkey"] == children["l_orderkey"], "left").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey", _dec(F.col("o_totalprice") / 1000, 5).alias("duration"),
        export_text(st).alias("start"), export_text(F.timestamp_add("HOUR", F.lit(1), st)).alias("end"), "kids")


def workout_xml(parts: DataFrame) -> DataFrame:
    attrs = F.concat(
        F.lit("<Workout workoutActivityType="), _q(F.concat(F.lit("HKWorkoutActivityType"), F.col("o_orderstatus"))),
        F.lit(" duration="), _q(F.col("duration")),
        F.lit(" sourceName="), _q(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string"))),
        F.lit(" creationDate="), _q(F.col("start")), F.lit(" startDate="), _q(F.col("start")),
        F.lit(" endDate="), _q(F.col("end")), F.lit(">"))
    meta = F.concat(F.lit('\n  <MetadataEntry key="HKAverageMETs" value="'), F.col("o_orderpriority"), F.lit('"/>'))
    route = F.concat(F.lit('\n  <WorkoutRoute sourceName="watch">\n    <MetadataEntry key="HKWeatherHumidity" value="'),
                     F.col("o_orderstatus"), F.lit('%"/>\n    <FileReference path="/private/var/workout-routes/route_'),
                     F.col("o_orderkey").cast("string"), F.lit('.gpx"/>\n  </WorkoutRoute>'))
    xml = F.concat(attrs, meta, F.lit("\n  "), F.coalesce(F.col("kids"), F.lit("")), route, F.lit("\n</Workout>"))
    return parts.select("o_orderkey", xml.alias("xml"))


def in_portions(spark: SparkSession, path: str, rows: int) -> list[list[str]]:
    """The files of a written table in groups of about ``rows`` rows (a file at least); the folder itself if it has no row."""
    counts = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("name")).count().orderBy("name").collect()
    groups, held = [], rows
    for r in counts:
        if held + r["count"] > rows:
            groups.append([])
            held = 0
        groups[-1].append(f"{path}/{r['name']}")
        held += r["count"]
    return groups or [[path]]


_WORKOUT_SQL = """WITH L AS (SELECT l_orderkey, l_returnflag, l_quantity FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber DESC, l_quantity DESC) = 1),
S AS (SELECT l_orderkey,
  max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS active_calories,
  max(l_quantity) FILTER (WHERE l_returnflag = 'N') AS basal_calories,
  max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS distance_walking FROM L GROUP BY 1),
O AS (SELECT *, o_orderdate + to_seconds(o_orderkey) AS st FROM orders)"""


@register("workout_scan", _WORKOUT_SQL + """
SELECT strftime(st, '%Y-%m-%d %H:%M:%S') || ' +0000' AS session_id, 'HKWorkoutActivityType' || o_orderstatus AS activity_type,
  CAST(CAST(o_totalprice / 1000 AS DECIMAL(18,5)) AS DOUBLE) AS duration_minutes, 'cust-' || CAST(o_custkey AS VARCHAR) AS source_name,
  'route_' || CAST(o_orderkey AS VARCHAR) || '.gpx' AS route_file,
  S.active_calories, S.basal_calories, CAST(NULL AS DOUBLE) AS distance_cycling, S.distance_walking,
  o_orderpriority AS avg_mets, o_orderstatus || '%' AS humidity, strftime(st, '%Y-%m-%d %H:%M:%S') AS start_date
FROM O LEFT JOIN S ON S.l_orderkey = O.o_orderkey""")
def workout_scan(spark, sf):
    """A2 through the splittable path: exports of workouts, written as files of several splits, are read
    a tag a row, and their workouts are regrouped and parsed.

    The text is many times larger than the tables that it renders, and the regrouping deals all of it. So that only a part of it is
    on disk at a time, all orders go through in portions: an export is written, scanned and deleted, and its rows are kept."""
    base = scratch_dir(spark, "workouts")
    files = max(FILES, spark.sparkContext.defaultParallelism)
    parts, export, stage, kept = (f"{base}/{name}" for name in ("parts", "export", "tags", "rows"))
    with dropping_shuffles(spark):
        made = workout_parts(spark, sf)
        made.write.option("maxRecordsPerFile", FILE_WORKOUTS).option("compression", "zstd").parquet(parts)
        for paths in in_portions(spark, parts, files * FILE_WORKOUTS):
            workout_xml(spark.read.schema(made.schema).parquet(*paths).repartition(files)).select("xml").write.text(export)
            rows = el.scan_elements(spark, export, default_manifest(), tags.WORKOUT_TAG, stage)
            delete_path(spark, export)  # the tags of its workouts are staged
            rows = ts_str(rows.select("session_id", "activity_type", "duration_minutes", "source_name", "route_file",
                                      "active_calories", "basal_calories", "distance_cycling", "distance_walking",
                                      "avg_mets", "humidity", "start_date"))
            rows.write.mode("append").parquet(kept)
            delete_path(spark, stage)
        delete_path(spark, parts)
    return spark.read.schema(rows.schema).parquet(kept)


@register("workout_attributes", """WITH O AS (SELECT *, o_orderdate + to_seconds(o_orderkey) AS st FROM orders)
SELECT strftime(st, '%Y-%m-%d %H:%M:%S') || ' +0000' AS session_id, 'HKWorkoutActivityType' || o_orderstatus AS activity_type,
  'cust-' || CAST(o_custkey AS VARCHAR) AS source_name, strftime(st, '%Y-%m-%dT%H:%M:%S') AS start_date,
  strftime(st + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') AS end_date FROM O""")
def workout_attributes(spark, sf):
    """B4 on self-closing ``<Workout/>`` elements (D7): attributes only; the
    key keeps the raw start text while the dates are normalised."""
    t = default_manifest().table("workouts")
    o = bridge.load(spark, sf, "orders")
    st = order_start(F.col("o_orderdate"), F.col("o_orderkey"))
    xml = F.concat(F.lit("<Workout workoutActivityType="), _q(F.concat(F.lit("HKWorkoutActivityType"), F.col("o_orderstatus"))),
                   F.lit(" sourceName="), _q(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string"))),
                   F.lit(" startDate="), _q(export_text(st)),
                   F.lit(" endDate="), _q(export_text(F.timestamp_add("HOUR", F.lit(1), st))), F.lit("/>"))
    parsed = el.parse_elements(o, xml, el.workout_schema(t))
    rows = el.extract_workouts(parsed, t)
    return rows.select("session_id", "activity_type", "source_name",
                       F.date_format("start_date", "yyyy-MM-dd'T'HH:mm:ss").alias("start_date"),
                       F.date_format("end_date", "yyyy-MM-dd'T'HH:mm:ss").alias("end_date"))


def workouts_of_lines(spark: SparkSession, sf: str, tie: Column, child: Column) -> DataFrame:
    """A workout per order whose children are its lines, in the order of their numbers (and ``tie``): parsed rows with ``l_orderkey``.
    An order has a few lines."""
    li = bridge.load(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", tie.alias("tie"), child.alias("child")).alias("line"))
    kids = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    xml = F.concat(F.lit('<Workout startDate="2024-01-01 00:00:00 +0000">'), F.array_join(F.transform("lines", lambda x: x["child"]), ""), F.lit("</Workout>"))
    return el.workouts_from_texts(kids.select("l_orderkey", xml.alias("xml")), default_manifest().table("workouts"), keep=("l_orderkey",))


@register("statistics_sum", """WITH L AS (SELECT l_orderkey, l_returnflag, l_quantity FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber DESC, l_quantity DESC) = 1)
SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS active_calories,
  max(l_quantity) FILTER (WHERE l_returnflag = 'N') AS basal_calories,
  max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS distance_walking FROM L GROUP BY 1""")
def statistics_sum(spark, sf):
    """Of several statistics of a type, the last one's sum."""
    child = F.concat(F.lit("<WorkoutStatistics type="), _q(F.try_element_at(_lit_map(FLAG_STAT), F.col("l_returnflag"))),
                     F.lit(" sum="), _q(_dec(F.col("l_quantity"))), F.lit("/>"))
    return workouts_of_lines(spark, sf, F.col("l_quantity"), child).select("l_orderkey", "active_calories", "basal_calories", "distance_walking")


@register("metadata_value", """WITH L AS (SELECT l_orderkey, l_linestatus, l_returnflag || '-' || CAST(l_linenumber AS VARCHAR) AS v
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linestatus
                                            ORDER BY l_linenumber DESC, l_returnflag || '-' || CAST(l_linenumber AS VARCHAR) DESC) = 1)
SELECT l_orderkey, max(v) FILTER (WHERE l_linestatus = 'F') AS avg_mets,
  max(v) FILTER (WHERE l_linestatus = 'O') AS temperature FROM L GROUP BY 1""")
def metadata_value(spark, sf):
    """Of several entries of a key, the last one's value."""
    value = F.concat(F.col("l_returnflag"), F.lit("-"), F.col("l_linenumber").cast("string"))
    child = F.concat(F.lit("<MetadataEntry key="), _q(F.try_element_at(_lit_map(STATUS_META), F.col("l_linestatus"))),
                     F.lit(" value="), _q(value), F.lit("/>"))
    return workouts_of_lines(spark, sf, value, child).select("l_orderkey", "avg_mets", "temperature")


@register("route_ref_basename", """SELECT o_orderkey, 'route_' || CAST(o_orderkey AS VARCHAR) || '.gpx' AS route_file FROM orders""")
def route_ref_basename(spark, sf):
    o = bridge.load(spark, sf, "orders")
    name = F.concat(F.lit("route_"), F.col("o_orderkey").cast("string"), F.lit(".gpx"))
    path = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("/private/var/mobile/workout-routes/"), name))
            .when(F.col("o_orderstatus") == "O", F.concat(F.lit("workout-routes/"), name, F.lit("/")))
            .otherwise(name))
    return o.select("o_orderkey", base_name(path).alias("route_file"))


# ---- summaries ------------------------------------------------------------------

@register("summary_scan", """SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
  CAST(CAST(o_totalprice / 100 AS DECIMAL(18,4)) AS DOUBLE) AS active_energy, 500.0::DOUBLE AS active_energy_goal,
  CAST(o_custkey % 90 AS DOUBLE) AS exercise_time, CAST(NULL AS DOUBLE) AS stand_hours,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS start_date
FROM orders""")
def summary_scan(spark, sf):
    """A3 + D16: daily summaries (some without ``dateComponents``)."""
    t = default_manifest().table("activity_summaries")
    o = bridge.load(spark, sf, "orders")
    date_attr = F.when(F.col("o_orderstatus") != "P",
                       F.concat(F.lit(' dateComponents="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"'))) \
                 .otherwise(F.lit(""))
    xml = F.concat(F.lit("<ActivitySummary"), date_attr,
                   F.lit(' activeEnergyBurned="'), _dec(F.col("o_totalprice") / 100, 4),
                   F.lit('" activeEnergyBurnedGoal="500" appleExerciseTime="'), (F.col("o_custkey") % 90).cast("string"),
                   F.lit('"/>'))
    path = f"{scratch_dir(spark, 'summaries')}/export"
    o.repartition(FILES).select(xml.alias("value")).write.text(path)
    rows = el.scan_elements(spark, path, default_manifest(), tags.SUMMARY_TAG)
    return ts_str(rows.select("date", "active_energy", "active_energy_goal", "exercise_time", "stand_hours", "start_date"))


# ---- GPX ----------------------------------------------------------------------------

@register("gpx_scan", """WITH E AS (SELECT event_id, event_type, date_trunc('second', ts) AS ts, value FROM events)
SELECT event_id, CAST(CAST(37 + value / 1000 AS DECIMAL(10,6)) AS DOUBLE) AS latitude,
  CAST(CAST(-122.0 + (event_id % 1000) / 1000 AS DECIMAL(10,6)) AS DOUBLE) AS longitude,
  CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS elevation, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
  CASE WHEN event_type IN ('click','view') THEN CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) END AS speed_ms
FROM E""")
def gpx_scan(spark, sf):
    """A5 + B18 + D6: track points with ``speed`` as a child, under
    ``<extensions>``, or absent (NULL)."""
    src = default_manifest().routes
    e = bridge.event_base(spark, sf)
    speed = _dec(F.col("value"))
    sp = (F.when(F.col("event_type") == "click", F.concat(F.lit("<speed>"), speed, F.lit("</speed>")))
          .when(F.col("event_type") == "view",
                F.concat(F.lit("<extensions><speed>"), speed, F.lit("</speed></extensions>")))
          .otherwise(F.lit("")))
    xml = F.concat(F.lit('<trkpt lat="'), _dec(F.lit(37.0) + F.col("value") / 1000, 6),
                   F.lit('" lon="'), _dec(F.lit(-122.0) + (F.col("event_id") % 1000) / 1000, 6),
                   F.lit('"><ele>'), _dec(F.col("value")), F.lit("</ele><time>"),
                   F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</time>"), sp, F.lit("</trkpt>"))
    parsed = el.parse_elements(e, xml, el.gpx_schema(src), keep=("event_id",))
    rows = el.extract_route_points(parsed, src, keep=("event_id",))
    return ts_str(rows.select("event_id", "latitude", "longitude", "elevation", "timestamp", "speed_ms"))
