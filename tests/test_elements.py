"""Workouts and daily summaries after the last record: split over tasks, nothing lost, stream = batch."""

import os

import pytest
from pyspark.sql import functions as F

from kardia.manifest import default_manifest
from kardia.operators.query import table_footprint
from kardia.plans.ingest import ingest_export, subject_from_path
from kardia.plans.store import TableStore
from kardia.sources import tags
from kardia.streaming import ingest as sing

HEAD = """<?xml version="1.0"?>
<HealthData>
 <Record type="HKQuantityTypeIdentifierHeartRate" startDate="2024-01-01 10:00:00 +0000" endDate="2024-01-01 10:01:00 +0000" value="61"/>
 <Record
  type="HKQuantityTypeIdentifierHeartRate" startDate="2024-01-01 11:00:00 +0000" endDate="2024-01-01 11:01:00 +0000" value="62"/>
 <Record\ttype="HKQuantityTypeIdentifierHeartRate" startDate="2024-01-01 12:00:00 +0000" endDate="2024-01-01 12:01:00 +0000" value="63"/>
 <RecordCount value="3"/>
"""


def workout(i, closing="/>"):
    return (f' <Workout workoutActivityType="HKWorkoutActivityTypeRunning" sourceName="watch {i}" '
            f'startDate="2024-{1 + i // 672 % 12:02d}-{1 + i // 24 % 28:02d} {i % 24:02d}:{i // 8064:02d}:00 +0000" endDate="2025-01-01 00:00:00 +0000"{closing}\n')


def export(folder, n, tail="</HealthData>\n"):
    os.makedirs(folder)
    with open(os.path.join(folder, "export.xml"), "w") as f:
        f.write(HEAD + "".join(workout(i) for i in range(n)) + ' <ActivitySummary dateComponents="2024-01-05" activeEnergyBurned="420.5"/>\n' + tail)
    return os.path.join(folder, "export.xml")


def test_many_workouts_after_the_last_record(spark, tmp):
    m = default_manifest()
    path = export(os.path.join(tmp, "ann"), 20_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        rows = tags.placed(tags.read_tags(spark, path))
        assert rows.agg(F.max(F.length("tag")).alias("n")).first()["n"] < 1000  # also behind the last record
        per_task = [r["n"] for r in rows.filter("name = 'Workout'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(per_task) == 20_000 and len(per_task) > 3 and max(per_task) < 10_000
        store = TableStore(spark, os.path.join(tmp, "store"), m)
        report = ingest_export(spark, path, store, m)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert store.read("workouts").count() == 20_000 == report.inserted["workouts"]
    assert store.read("vitals").count() == 3  # a line break or a tab after the tag name is no loss
    assert report.total_mapped == 20_004 and report.mapped["activity_summaries"] == 1 and report.quarantined == 0
    again = ingest_export(spark, path, store, m)
    assert again.total_mapped == 20_004 and sum(again.inserted.values()) == 0


def test_cut_off_element_is_quarantined_once(spark, tmp):
    m = default_manifest()
    path = export(os.path.join(tmp, "ben"), 2, tail=workout(5, closing=">") + '  <WorkoutStatistics type="x" sum')
    store = TableStore(spark, os.path.join(tmp, "store"), m)
    for _ in range(2):
        report = ingest_export(spark, path, store, m)
        assert report.quarantined == 1
        kept = spark.read.parquet(os.path.join(tmp, "store", "_quarantine")).collect()
        assert len(kept) == 1 and 'sourceName="watch 5"' in kept[0]["raw"] and kept[0]["subject_id"] == "ben"
    assert store.read("workouts").count() == 2


def test_elements_named_with_a_line_break(spark, tmp):
    m = default_manifest()
    path = export(os.path.join(tmp, "cleo"), 2, tail=workout(7).replace("<Workout ", "<Workout\n  "))
    store = TableStore(spark, os.path.join(tmp, "store"), m)
    assert ingest_export(spark, path, store, m).mapped["workouts"] == 3 and store.read("workouts").count() == 3


def test_stream_equals_batch(spark, tmp):
    m = default_manifest()
    paths = [export(os.path.join(tmp, "exports", who), n) for who, n in (("ann", 5), ("ben", 3))]
    batch, stream = (TableStore(spark, os.path.join(tmp, d), m) for d in ("batch", "stream"))
    ingest_export(spark, paths, batch, m)
    sing.start_ingest(spark, os.path.join(tmp, "exports"), stream, m, os.path.join(tmp, "ckpt")).awaitTermination()
    for t in ("vitals", "workouts", "activity_summaries"):
        a, b = (sorted(map(str, s.read(t).collect())) for s in (batch, stream))
        assert a == b and a, t
    whole = TableStore(spark, os.path.join(tmp, "folder"), m)  # a folder of people's folders is read as deep as the stream reads it
    assert ingest_export(spark, os.path.join(tmp, "exports"), whole, m).total_mapped == 16


def test_folders_of_one_name_are_refused(spark, tmp):
    m = default_manifest()
    paths = [export(os.path.join(tmp, who, "apple_health_export"), 1) for who in ("ann", "ben")]
    store = TableStore(spark, os.path.join(tmp, "store"), m)
    try:
        ingest_export(spark, paths, store, m)
        raise AssertionError("two people would have been one")
    except ValueError as e:
        assert "apple_health_export" in str(e)
    ingest_export(spark, paths, store, m, subject=F.regexp_extract("file_path", "([^/]+)/apple_health_export", 1))
    assert {r["subject_id"] for r in store.read("workouts").collect()} == {"ann", "ben"}


def test_live_buckets_count_a_record_once(spark, tmp):
    m = default_manifest()
    for part in ("first", "again"):
        export(os.path.join(tmp, "exports", part, "ann"), 0)
    with open(os.path.join(tmp, "exports", "first", "ann", "more.xml"), "w") as f:
        f.write('<Record type="HKQuantityTypeIdentifierHeartRate" startDate="never" value="70"/>')
    named = subject_from_path(F.col("file_path"))  # two folders of one name are one person here, so the rule is stated
    sing.run_bucket_stream(spark, os.path.join(tmp, "exports"), m, "vitals", "hour", {"heart_rate": "count"}, os.path.join(tmp, "out"), os.path.join(tmp, "ckpt"), subject=named)
    got = {r["time_bucket"]: r["heart_rate"] for r in spark.read.parquet(os.path.join(tmp, "out")).collect()}
    assert got == {"2024-01-01T10:00:00Z": 1, "2024-01-01T11:00:00Z": 1, "2024-01-01T12:00:00Z": 1, None: 1}


def test_footprint_is_a_listing(spark, tmp):
    path = os.path.join(tmp, "t")
    spark.range(1000).repartition(3).write.parquet(path)
    r = table_footprint(spark, {"t": path}).first()
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert r["file_count"] == len(files) and r["bytes"] == sum(os.path.getsize(os.path.join(path, f)) for f in files)


def test_side_cars_are_read_once_and_at_any_depth(spark, tmp, monkeypatch):
    from kardia.plans import ingest
    m = default_manifest()
    folder = os.path.join(tmp, "dee", m.routes.folder)
    os.makedirs(folder)
    point = '<trkpt lat="47.{0}" lon="8.{0}"><ele>4{0}</ele><time>2024-05-01T10:0{0}:00Z</time>{1}</trkpt>'
    speeds = ["<speed>1.5</speed>", "<extensions><speed>2.5</speed></extensions>",
              "<extensions><x:TrackPoint><x:inner><x:speed unit='m'>3.5</x:speed></x:inner></x:TrackPoint></extensions>", ""]
    with open(os.path.join(folder, "a.gpx"), "w") as f:
        f.write("<gpx xmlns:x='u'><trk><trkseg>" + "".join(point.format(i, s) for i, s in enumerate(speeds)) + "</trkseg></trk></gpx>")
    store = TableStore(spark, os.path.join(tmp, "store"), m)
    table = m.routes.target_table
    assert ingest.import_external(spark, os.path.join(tmp, "dee"), store, m, subject="dee")[table] == 4
    assert [r["speed_ms"] for r in store.read(table).orderBy("timestamp").collect()] == [1.5, 2.5, 3.5, None]
    monkeypatch.setattr(ingest.el, "scan_gpx", lambda *a, **k: 1 / 0)  # nothing is read the second time
    assert ingest.import_external(spark, os.path.join(tmp, "dee"), store, m, subject="dee")[table] == 0
    listed = {who: ingest.new_files(spark, [folder], m.routes, store, F.lit(who)).count() for who in ("eve", "dee")}
    assert listed == {"eve": 1, "dee": 0}


def test_side_cars_of_many_people(spark, tmp, monkeypatch):
    """One call: each person's files under their own folder, in blocks; a broken file is quarantined and read again only when it changes."""
    from kardia.plans import ingest
    m = default_manifest()
    store = TableStore(spark, os.path.join(tmp, "store"), m)
    point = '<gpx><trk><trkseg><trkpt lat="47.{0}" lon="8.{0}"><ele>4{0}</ele><time>2024-05-01T10:0{0}:00Z</time></trkpt></trkseg></trk></gpx>'
    for i, who in enumerate(("ann", "ben", "cy d")):
        folder = os.path.join(tmp, "people", who, m.routes.folder)
        os.makedirs(folder)
        for name in ("a.gpx", "b.gpx"):
            with open(os.path.join(folder, name), "w") as f:
                f.write(point.format(i))
    bad = os.path.join(tmp, "people", "ben", m.ecg.folder)
    os.makedirs(bad)
    for name, text in (("good.csv", "Sample Rate,15 hertz\n1.5\n2.5\n"), ("bad.csv", "no recording\n")):
        with open(os.path.join(bad, name), "w") as f:
            f.write(text)
    people = os.path.join(tmp, "people")
    assert ingest.import_external(spark, people, store, m, block_files=2) == {m.ecg.target_table: 1, m.routes.target_table: 6}
    stored = {(r["subject_id"].replace("%20", " "), r["file_name"]) for r in store.read(m.routes.target_table).collect()}
    assert stored == {(who, f) for who in ("ann", "ben", "cy d") for f in ("a.gpx", "b.gpx")}
    kept = spark.read.parquet(os.path.join(tmp, "store", "_quarantine")).collect()
    assert [(r["subject_id"], r["raw"].rpartition("/")[2]) for r in kept] == [("ben", "bad.csv")]
    log = store.log.read()
    assert log.agg(F.sum("files")).first()[0] == 8 and log.agg(F.sum("quarantined")).first()[0] == 1
    with monkeypatch.context() as blind:  # the second run reads no content
        blind.setattr(ingest.el, "scan_gpx", lambda *a, **k: 1 / 0)
        blind.setattr(ingest.ecg_src, "read_ecg_files", lambda *a, **k: 1 / 0)
        assert ingest.import_external(spark, people, store, m) == {m.ecg.target_table: 0, m.routes.target_table: 0}
    with open(os.path.join(bad, "bad.csv"), "w") as f:
        f.write("Sample Rate,15 hertz\n3.5\n")
    assert ingest.import_external(spark, people, store, m)[m.ecg.target_table] == 1


PEOPLE = [f' <Workout workoutActivityType="HKWorkoutActivityTypeRunning" sourceName="user-{p}" startDate="2024-03-0{p} 10:00:00 +0000" endDate="2024-03-0{p} 11:00:00 +0000">\n'
          f'  <MetadataEntry key="HKAverageMETs" value="{p} kcal"/>\n <WorkoutEvent type="pause"></WorkoutEvent></Workout>\n'
          f' <ActivitySummary dateComponents="2024-03-0{p}" activeEnergyBurned="{p}" sourceName="user-{p}"></ActivitySummary>\n' for p in (1, 2, 3)]


def rule():
    return F.expr("regexp_extract(chunk, 'sourceName=\"user-([^\"]*)\"', 1)")



def people_export(folder, broken_line=False):
    """Three people's elements in one file, before, between and behind records."""
    record = ' <Record type="HKQuantityTypeIdentifierHeartRate" sourceName="user-2" startDate="2024-01-0{0} 10:00:00 +0000" endDate="2024-01-01 10:01:00 +0000" value="6{0}">\n  <MetadataEntry key="HKAverageMETs" value="not a workout\'s"/>\n </Record>\n'
    text = "<HealthData>\n" + PEOPLE[0] + record.format(1) + PEOPLE[1] + record.format(2) + PEOPLE[2] + "</HealthData>\n"
    os.makedirs(folder)
    with open(os.path.join(folder, "export.xml"), "w") as f:
        f.write(text.replace("<Workout work", "<Workout\n work").replace("<ActivitySummary date", "<ActivitySummary\n\tdate") if broken_line else text)
    return os.path.join(folder, "export.xml")


def test_each_element_has_its_own_subject(spark, tmp):
    """Batch and stream, with and without a line break behind the element's name, at any split size."""
    m = default_manifest()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for i, broken in enumerate((False, True)):
        folder = os.path.join(tmp, f"exports{i}")
        path = people_export(os.path.join(folder, "everyone"), broken)
        batch, stream = (TableStore(spark, os.path.join(tmp, f"{d}{i}"), m, buckets=3) for d in ("batch", "stream"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        try:
            ingest_export(spark, path, batch, m, subject=rule())
            sing.start_ingest(spark, folder, stream, m, os.path.join(tmp, f"ckpt{i}"), subject=rule()).awaitTermination()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        for store in (batch, stream):
            assert sorted((r["subject_id"], r["avg_mets"]) for r in store.read("workouts").collect()) == [("1", "1 kcal"), ("2", "2 kcal"), ("3", "3 kcal")]
            assert sorted((r["subject_id"], r["date"]) for r in store.read("activity_summaries").collect()) == [(str(p), f"2024-03-0{p}") for p in (1, 2, 3)]
            assert {r["subject_id"] for r in store.read("vitals").collect()} == {"2"} and store.read("vitals").count() == 2
            log = {r["table_name"]: (r["mapped"], r["inserted"]) for r in store.log.read().collect()}
            assert log["workouts"] == log["activity_summaries"] == (3, 3) and log["vitals"] == (2, 2)


def test_workouts_before_many_records(spark, tmp):
    """No cap: what lies between two workouts is no part of either."""
    m = default_manifest()
    folder = os.path.join(tmp, "ida")
    os.makedirs(folder)
    record = ' <Record type="HKQuantityTypeIdentifierStepCount" startDate="2024-01-01 10:00:00 +0000" endDate="2024-01-01 10:00:00 +0000" value="{}"/>\n'
    with open(os.path.join(folder, "export.xml"), "w") as f:
        f.write(workout(0) + "".join(record.format(i) for i in range(5000)) + workout(1, ">") + "".join(record.format(i) for i in range(5000, 9000)))
    store = TableStore(spark, os.path.join(tmp, "store"), m)
    report = ingest_export(spark, folder, store, m)
    assert report.mapped["workouts"] == 1 and report.quarantined == 1 and report.mapped["activity"] == 9000 == report.inserted["activity"]


def test_folders_below_one_root_are_told_apart(spark, tmp):
    """Equal folder names are found among the files read, in batch, in a stream, and in a later batch."""
    m = default_manifest()
    for who in ("p1", "p2"):
        people_export(os.path.join(tmp, "w", who, "apple_health_export"))
    with pytest.raises(ValueError, match="apple_health_export"):
        ingest_export(spark, os.path.join(tmp, "w"), TableStore(spark, os.path.join(tmp, "s1"), m), m)
    later = TableStore(spark, os.path.join(tmp, "s2"), m)
    ingest_export(spark, os.path.join(tmp, "w", "p1"), later, m)
    with pytest.raises(ValueError, match="apple_health_export"):
        ingest_export(spark, os.path.join(tmp, "w", "p2"), later, m)
    ingest_export(spark, os.path.join(tmp, "w", "p1"), later, m)  # the same folder again is no clash
    with pytest.raises(Exception, match="apple_health_export"):
        sing.start_ingest(spark, os.path.join(tmp, "w"), TableStore(spark, os.path.join(tmp, "s3"), m), m, os.path.join(tmp, "ckpt")).awaitTermination()


def test_batch_killed_between_two_tables(spark, tmp, monkeypatch):
    """The replay completes the batch; its counts are those of a clean run; readers of committed rows see it then only."""
    m = default_manifest()
    path = people_export(os.path.join(tmp, "everyone"))
    clean, killed = (TableStore(spark, os.path.join(tmp, d), m) for d in ("clean", "killed"))
    ingest_export(spark, path, clean, m, rule(), batch="b1")

    def dies(*args, **kw):
        raise KeyboardInterrupt
    monkeypatch.setattr("kardia.plans.ingest.write_elements", dies)
    with pytest.raises(KeyboardInterrupt):
        ingest_export(spark, path, killed, m, rule(), batch="b1")
    monkeypatch.undo()
    assert killed.read("vitals").count() == 2 and killed.read("vitals", committed=True).count() == 0 and killed.log.read().count() == 0
    report = ingest_export(spark, path, killed, m, rule(), batch="b1")
    assert sorted(map(str, killed.log.read().collect())) == sorted(map(str, clean.log.read().collect()))
    assert report.inserted["vitals"] == 2 and killed.read("vitals", committed=True).count() == 2
    again = ingest_export(spark, path, killed, m, rule(), batch="b1")  # committed: nothing is read
    assert again.mapped == report.mapped and again.inserted == report.inserted and killed.read("workouts").count() == 3


def test_append_leaves_the_stored_side_in_its_buckets(spark, tmp):
    """Only the batch is dealt; the stored keys are read bucket by bucket."""
    m = default_manifest()
    store = TableStore(spark, os.path.join(tmp, "store"), m, buckets=5)
    path = people_export(os.path.join(tmp, "everyone"))
    ingest_export(spark, path, store, m, rule())
    assert TableStore(spark, os.path.join(tmp, "store"), m, buckets=9).buckets == 5
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, _ = store.new_rows("vitals", store.read("vitals"))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[plan.index("SortMergeJoin"):]
    depth = [len(line) - len(line.lstrip(" :+-")) for line in join.splitlines()]
    right = [i for i, d in enumerate(depth) if d == depth[1]][1]
    stored = "\n".join(join.splitlines()[right:])
    assert "Exchange" not in stored and "Bucketed: true" in stored and "Exchange" in join


def test_live_buckets_hold_one_row_each(spark, tmp):
    """An export delivered twice, and a late row: each counts once; the state has a row per bucket; a batch merged twice changes nothing."""
    m = default_manifest()
    export(os.path.join(tmp, "exports", "first"), 0)
    run = lambda: sing.run_bucket_stream(spark, os.path.join(tmp, "exports"), m, "vitals", "day", {"heart_rate": "avg", "hrv_sdnn": "count"},
                                         os.path.join(tmp, "out"), os.path.join(tmp, "ckpt"), subject=F.lit("ann"))
    run()
    export(os.path.join(tmp, "exports", "again"), 0)
    with open(os.path.join(tmp, "exports", "again", "late.xml"), "w") as f:
        f.write('<Record type="HKQuantityTypeIdentifierHeartRate" startDate="2024-01-01 09:00:00 +0000" value="70"/><Record type="HKQuantityTypeIdentifierHeartRate" startDate="2023-12-31 09:00:00 +0000" value="50"/>')
    live = run()
    want = {("2024-01-01", (61 + 62 + 63 + 70) / 4, 0), ("2023-12-31", 50.0, 0)}
    assert {tuple(r) for r in live.read().collect()} == want and live.read().count() == 2
    live.merge(live.read().limit(0), open(os.path.join(tmp, "out_merged", "last")).read())
    assert {tuple(r) for r in live.read().collect()} == want
