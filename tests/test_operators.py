"""Operators against brute force on small fixtures, plus session edge cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from kardia.operators import dedupe, intervals, prefix, routes, sessions
from kardia.operators.sequence import with_previous

T0 = datetime(2024, 1, 1)


def ts(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def points(spark):
    rnd = random.Random(3)
    rows = []
    # one hot key with most rows, several small ones; equal timestamps included
    for i in range(600):
        key = "hot" if i < 400 else f"k{i % 7}"
        rows.append((key, i, ts(rnd.randint(0, 3 * 24 * 60)), float(rnd.randint(0, 50))))
    return spark.createDataFrame(rows, "k string, seq long, t timestamp, v double")


def test_with_previous_equals_single_window(spark, points):
    got = with_previous(points, ["k"], "t", ["seq"], ["v"])
    got = {r["seq"]: (r["prev"]["seq"] if r["prev"] else None) for r in got.collect()}
    w = Window.partitionBy("k").orderBy("t", "seq")
    exp = {r["seq"]: r["p"] for r in points.select("seq", F.lag("seq").over(w).alias("p")).collect()}
    assert got == exp


def test_range_join_and_counts_equal_naive(spark, points):
    rnd = random.Random(5)
    iv_rows = []
    for j in range(40):
        s = rnd.randint(-60, 3 * 24 * 60)
        e = s + rnd.choice([-30, 0, 5, 90, 24 * 60, 40 * 60])     # includes end < start
        iv_rows.append((f"s{j}", rnd.choice(["hot", "k1", "k2"]), ts(s), ts(e)))
    iv_rows.append(("none", "hot", None, ts(10)))
    iv = spark.createDataFrame(iv_rows, "sid string, k string, s timestamp, e timestamp")
    pts = points.withColumn("cat", F.when(F.col("v") > 25, "hi").otherwise("lo"))

    naive = {}
    for sid, k, s, e in iv_rows:
        naive[sid] = [0, 0, 0]
        if s is None or e is None or e < s:
            continue
        for r in pts.collect():
            if r["k"] == k and s <= r["t"] <= e:
                naive[sid][0] += 1
                naive[sid][1 if r["cat"] == "hi" else 2] += 1

    pairs = intervals.range_join(iv, pts.select("k", "t", "cat"), "s", "e", "t", equi_cols=["k"], bin_unit="day")
    got_pairs = {r["sid"]: r["n"] for r in pairs.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {k: v[0] for k, v in naive.items() if v[0]} == got_pairs

    counts = intervals.interval_point_counts(iv, pts, "sid", "s", "e", "t", category_col="cat",
                                             categories=("hi", "lo"), equi_cols=["k"])
    got = {r["sid"]: [r["n"], r["n_hi"], r["n_lo"]] for r in counts.collect()}
    assert got == naive


def test_range_join_plan_has_no_nested_loop(spark, points):
    iv = spark.createDataFrame([("a", ts(0), ts(100))], "sid string, s timestamp, e timestamp")
    plan = intervals.range_join(iv, points.select("t", "v"), "s", "e", "t")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_dedupe_first_wins_equals_row_number(spark, points):
    got = dedupe.dedupe_first_wins(points, ["k"], order_cols=["t", "seq"])
    w = Window.partitionBy("k").orderBy("t", "seq")
    exp = points.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_dedupe_null_keys_bypass(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, v int")
    assert dedupe.dedupe_first_wins(df, ["k"], ["v"]).count() == 3


def test_route_edges(spark):
    rows = [("single", 1, ts(0), 37.0, -122.0, 10.0),
            ("same", 1, ts(0), 37.0, -122.0, 10.0), ("same", 2, ts(1), 37.0, -122.0, 10.0),
            ("down", 1, ts(0), 37.0, -122.0, 30.0), ("down", 2, ts(1), 37.001, -122.0, 20.0),
            ("down", 3, ts(1), 37.002, -122.0, 25.0)]           # equal timestamps: tie-break by seq
    pts = spark.createDataFrame(rows, "file_name string, point_seq long, timestamp timestamp, "
                                      "latitude double, longitude double, elevation double")
    tot = {r["file_name"]: r for r in routes.route_totals(pts).collect()}
    assert tot["single"]["distance_km"] == 0.0 and tot["single"]["elevation_gain_m"] == 0.0
    assert tot["same"]["distance_km"] == 0.0
    assert tot["down"]["elevation_gain_m"] == 5.0
    assert abs(tot["down"]["distance_km"] - 0.2224) < 1e-3
    w = spark.createDataFrame([("w1", "down"), ("w2", None), ("w3", "missing.gpx")],
                              "session_id string, route_file string")
    j = {r["session_id"]: r for r in routes.workout_routes(w, routes.route_totals(pts)).collect()}
    assert j["w2"]["calculated_distance_km"] is None              # no route: no route fields
    assert j["w3"]["point_count"] == 0 and j["w3"]["calculated_distance_km"] == 0.0


def test_hr_zone_edges(spark):
    w = spark.createDataFrame([("a", ts(0), ts(10)), ("empty", ts(100), ts(110))],
                              "session_id string, start_date timestamp, end_date timestamp")
    s = spark.createDataFrame([(ts(0), 114.0), (ts(5), 133.0), (ts(10), 171.0), (ts(11), 100.0), (ts(3), 0.0)],
                              "start_date timestamp, heart_rate double")
    out = {r["session_id"]: r for r in sessions.hr_zone_histogram(w, s).collect()}
    a = out["a"]
    assert a["sample_count"] == 3                     # both ends inclusive, hr > 0 only
    assert (a["Z2_Aerobic"], a["Z3_Steady"], a["Z5_Anaerobic"]) == (1, 1, 1)
    e = out["empty"]
    assert e["sample_count"] == 0 and e["Z1_Recovery"] == 0 and e["max_hr_used"] == 190.0


def test_sleep_edges(spark):
    rows = [(6, ts(0), ts(60)), (None, ts(0), ts(60)), (5, ts(23 * 60), ts(25 * 60)),
            (1, ts(120), ts(60)), (2, None, ts(60))]
    s = spark.createDataFrame(rows, "sleep_stage long, start_date timestamp, end_date timestamp")
    b = {(r["date"], r["stage"]): r["seconds"] for r in sessions.sleep_breakdown(s).collect()}
    assert b[("2024-01-01", "Unknown")] == 3600.0
    assert b[("2024-01-01", "REM")] == 7200.0          # over midnight: counts on its start date
    assert b[("2024-01-01", "Asleep")] == -3600.0      # negative kept
    assert len(b) == 3                                 # NULL stage and NULL date skipped
    t = sessions.sleep_total_hours(s, day="2024-01-01").first()
    assert t["total_sleep_hours"] == 2.0 and t["asleep_hours"] == 1.0


def test_recovery_edges(spark):
    as_of = "2024-01-30"
    rows = [("u", datetime(2024, 1, 23), 50.0, 60.0),     # exactly at as_of-7 midnight
            ("u", datetime(2024, 1, 29, 5), 80.0, 70.0),
            ("u", datetime(2024, 1, 29, 6), -5.0, 0.0),   # ignored
            ("u", datetime(2024, 1, 10), 500.0, 10.0),    # outside the window
            ("v", datetime(2024, 1, 25), 40.0, None)]
    v = spark.createDataFrame(rows, "subject_id string, start_date timestamp, hrv_sdnn double, resting_hr double")
    out = {r["subject_id"]: r for r in sessions.recovery_score(v, as_of, ["subject_id"]).collect()}
    u = out["u"]
    assert u["hrv_baseline"] == 65.0 and u["hrv_current"] == 80.0
    assert u["rhr_baseline"] == 65.0 and u["rhr_current"] == 70.0
    # 80/65*100 = 123.08 - 5*(70-65) = 98.08 -> clamp 98
    assert u["recovery_score"] == 98 and u["status"] == "Optimal"
    assert out["v"]["recovery_score"] == 0 and out["v"]["status"] == "Recovery Needed"
    daily = {(r["subject_id"], r["as_of"]): r["recovery_score"]
             for r in sessions.recovery_daily(v, ["subject_id"]).collect()}
    # as_of 01-29: base since 01-22 (50, 80 | 60, 70), current since 01-28 (80 | 70) -> 98
    assert daily[("u", "2024-01-29")] == 98
    # as_of 01-23: only the row of that day lies in both windows
    assert daily[("u", "2024-01-23")] == 100
    # later rows never change an earlier day
    earlier = sessions.recovery_daily(v.filter("start_date < '2024-01-24'"), ["subject_id"]).collect()
    assert all(daily[(r["subject_id"], r["as_of"])] == r["recovery_score"] for r in earlier)


def test_recovery_of_a_subject_without_recent_rows(spark):
    v = spark.createDataFrame([("old", datetime(2023, 1, 1), 50.0, 60.0), ("new", datetime(2024, 1, 29), 50.0, 60.0)],
                              "subject_id string, start_date timestamp, hrv_sdnn double, resting_hr double")
    out = {r["subject_id"]: r for r in sessions.recovery_score(v, "2024-01-30", ["subject_id"]).collect()}
    assert out["old"]["recovery_score"] == 0 and out["old"]["status"] == "Recovery Needed" and out["new"]["recovery_score"] == 100


def test_two_people_with_equal_sessions_and_routes(spark):
    """Session ids and route names repeat across people; nobody gets another one's numbers."""
    w = spark.createDataFrame([(p, "2024-01-01 08:00:00", ts(0), ts(60), "morning.gpx") for p in ("a", "b")],
                              "subject_id string, session_id string, start_date timestamp, end_date timestamp, route_file string")
    s = spark.createDataFrame([("a", ts(5), 100.0), ("a", ts(6), 120.0), ("a", ts(7), 180.0), ("b", ts(5), 100.0), ("b", ts(6), 90.0), (None, ts(5), 99.0)],
                              "subject_id string, start_date timestamp, heart_rate double")
    zones = {r["subject_id"]: r["sample_count"] for r in sessions.hr_zone_histogram(w, s).collect()}
    assert zones == {"a": 3, "b": 2}
    pts = spark.createDataFrame([(p, "morning.gpx", i, ts(i), base + i / 1000, -122.0, 10.0 * i, 1.0) for p, base in (("a", 37.0), ("b", 47.0)) for i in range(3)],
                                "subject_id string, file_name string, point_seq long, timestamp timestamp, latitude double, longitude double, elevation double, speed_ms double")
    j = {r["subject_id"]: r for r in routes.workout_routes(w, routes.route_totals(pts)).collect()}
    assert all(j[p]["point_count"] == 3 and abs(j[p]["calculated_distance_km"] - 0.2224) < 1e-3 for p in ("a", "b"))
    points = [(r["subject_id"], r["sequence"], round(r["latitude"], 3)) for r in routes.workout_points(w, pts).orderBy("subject_id", "sequence").collect()]
    assert points == [(p, i + 1, round(base + i / 1000, 3)) for p, base in (("a", 37.0), ("b", 47.0)) for i in range(3)]
    assert routes.route_points_of(pts, "morning.gpx", subject="b").count() == 3
    pairs = intervals.range_join(w.select("subject_id", "session_id", "start_date", "end_date"), s.select("subject_id", F.col("start_date").alias("t"), "heart_rate"), "start_date", "end_date", "t")
    assert pairs.count() == 5


def test_route_points_of_orders_one_file(spark):
    rows = [("a", 2, ts(5), 1.0, 1.0, 1.0), ("a", 1, ts(5), 1.0, 1.0, 1.0), ("a", 3, ts(1), 1.0, 1.0, 1.0),
            ("b", 1, ts(0), 1.0, 1.0, 1.0)]
    pts = spark.createDataFrame(rows, "file_name string, point_seq long, timestamp timestamp, "
                                      "latitude double, longitude double, elevation double")
    assert [r["point_seq"] for r in routes.route_points_of(pts, "a").collect()] == [3, 1, 2]


def test_csv_export(spark, tmp):
    """Header, NULL as empty; the text form matches csv_lines."""
    import glob
    import os
    from kardia.operators.query import csv_header, csv_lines, export_csv
    df = spark.createDataFrame([(1, "x,y", None, 60.0), (2, None, 3, 0.5)], "id int, s string, n int, d double")
    out = os.path.join(tmp, "csv")
    export_csv(df.coalesce(1), out)
    parts = [open(p).read().splitlines() for p in sorted(glob.glob(os.path.join(out, "part-*")))]
    text = [line for part in parts for line in part]
    assert text[0] == csv_header(df) == "id,s,n,d" and text.count(text[0]) == 1
    assert text[1:] == ['1,"x,y",,60', "2,,3,0.5"]
    lines = sorted(r["line"] for r in csv_lines(df).collect())
    assert lines == ['1,"x,y",,60', "2,,3,0.5"]          # shortest float text (60.0 -> 60)


def test_a_far_end_date_makes_few_rows(spark):
    """An interval of any length lies in two dyadic intervals at most."""
    iv = spark.createDataFrame([("a", "2024-01-01 10:00:00", "4001-01-01 00:00:00"), ("b", "2024-01-01 10:00:00", "2024-01-01 11:00:00"),
                                ("c", None, "2024-01-01 11:00:00"), ("d", "2024-01-02 00:00:00", "2024-01-01 00:00:00")], "sid string, s string, e string")
    iv = iv.select("sid", F.col("s").cast("timestamp").alias("s"), F.col("e").cast("timestamp").alias("e"))
    covered = intervals.covered(iv, "s", "e", "minute").groupBy("sid").count().collect()
    assert {r["sid"] for r in covered} == {"a", "b"} and all(r["count"] <= 2 for r in covered)


def test_range_join_equals_naive_join(spark):
    rng = random.Random(11)
    base = 1_700_000_000
    spans = [(f"i{i}", rng.choice("xy"), base + (a := rng.randrange(-50_000, 50_000)), base + a + rng.choice([0, 1, 59, 3600, 90_000, 10 ** 9])) for i in range(120)]
    points = [(i, rng.choice("xy"), base + rng.randrange(-80_000, 200_000)) for i in range(300)]
    iv = spark.createDataFrame(spans, "sid string, k string, s long, e long").select("sid", "k", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    pt = spark.createDataFrame(points, "p long, k string, t long").select("p", "k", F.timestamp_seconds("t").alias("t"))
    want = sorted((sid, p) for sid, k, s, e in spans for p, j, t in points if k == j and s <= t <= e)
    for unit in ("minute", "day"):
        got = intervals.range_join(iv, pt, "s", "e", "t", equi_cols=["k"], bin_unit=unit)
        assert sorted((r["sid"], r["p"]) for r in got.collect()) == want


def test_ranges_split_a_hot_key_and_instant(spark):
    """A third of all rows at one key and instant: no task has three times the median; running values equal those of one window."""
    rows = spark.range(30_000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id % 500 AS STRING)) AS k",
                                          "IF(id % 3 = 0, TIMESTAMP'2024-01-01 10:00:00', timestamp_seconds(1700000000 + id * 7)) AS t", "id AS seq", "id % 7 AS v").repartition(4)
    ranged = prefix.in_ranges(rows, ["k"], ["t", "seq"])
    sizes = sorted(r["n"] for r in ranged.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect())
    assert sum(sizes) == 30_000 and len(sizes) > 5 and sizes[-1] < 3 * sizes[len(sizes) // 2]
    got = prefix.with_running_sums(prefix.with_previous_row(ranged, ["k"], F.struct("seq"), "prev"), ["k"], {"total": F.col("v")})
    w = Window.partitionBy("k").orderBy("t", "seq")
    want = rows.select("k", "seq", F.lag("seq").over(w).alias("p"), F.sum("v").over(w).alias("total"))
    assert got.select("k", "seq", F.col("prev.seq").alias("p"), "total").exceptAll(want).count() == 0 and got.count() == 30_000
