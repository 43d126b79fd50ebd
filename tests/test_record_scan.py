"""A1/A8/B1–B3/C1 on export files with the awkward shapes of FIXTURES §3."""

import os

from pyspark.sql import functions as F

from kardia.manifest import default_manifest
from kardia.plans.ingest import ingest_export
from kardia.plans.store import TableStore
from kardia.sources import records as rec

EXPORT = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE HealthData>
<HealthData locale="en_US">
 <ExportDate value="2024-02-01 00:00:00 +0000"/>
 <Me HKCharacteristicTypeIdentifierBiologicalSex="x"/>
 <Record type="HKQuantityTypeIdentifierHeartRate" sourceName="Watch &amp; Co" unit="count/min" creationDate="2024-01-01 10:00:00 -0500" startDate="2024-01-01 10:00:00 -0500" endDate="2024-01-01 10:01:00 -0500" value="60"/>
 <Record type="HKQuantityTypeIdentifierHeartRate" sourceName="Phone" unit="count/min" creationDate="2024-01-02 10:00:00 -0500" startDate="2024-01-01 10:00:00 -0500" endDate="2024-01-01 10:01:00 -0500" value="60"/>
 <Record type="HKQuantityTypeIdentifierHeartRate"
   sourceName="Watch" unit="count/min"
   creationDate="2024-01-01 11:00:00 +0000" startDate="2024-01-01 11:00:00 +0000" endDate="2024-01-01 11:01:00 +0000" value="72">
  <MetadataEntry key="HKMetadataKeyHeartRateMotionContext" value="1"/>
 </Record>
 <Correlation type="HKCorrelationTypeIdentifierBloodPressure">
  <Record type="HKQuantityTypeIdentifierBodyMass" sourceName="Scale" unit="kg" startDate="2024-01-03 08:00:00 +0000" endDate="2024-01-03 08:00:00 +0000" value="70.5"/>
 </Correlation>
 <Record type="HKQuantityTypeIdentifierSomethingUnmapped" startDate="2024-01-03 08:00:00 +0000" value="1"/>
 <Record type="HKCategoryTypeIdentifierSleepAnalysis" sourceName="Watch" startDate="2024-01-03 01:00:00 +0000" endDate="2024-01-03 02:00:00 +0000" value="HKCategoryValueSleepAnalysisAsleepREM"/>
 <Record type="HKQuantityTypeIdentifierStepCount" sourceName="Phone" startDate="not a date" endDate="2024-01-03 02:00:00 +0000" value="12"/>
 <Record type="HKQuantityTypeIdentifierRestingHeartRate" sourceName="Watch" note="a > b" startDate="2024-01-04 08:00:00 +0000" endDate="2024-01-04 08:00:00 +0000" value="55"/>
 <Workout workoutActivityType="HKWorkoutActivityTypeRunning" duration="30.5" sourceName="Watch" creationDate="2024-01-05 08:00:00 +0000" startDate="2024-01-05 07:00:00 +0000" endDate="2024-01-05 07:30:00 +0000">
  <MetadataEntry key="HKAverageMETs" value="9.1 kcal/hr·kg"/>
  <WorkoutStatistics type="HKQuantityTypeIdentifierActiveEnergyBurned" sum="100" unit="kcal"/>
  <WorkoutStatistics type="HKQuantityTypeIdentifierActiveEnergyBurned" sum="250.5" unit="kcal"/>
  <WorkoutStatistics type="HKQuantityTypeIdentifierBasalEnergyBurned" unit="kcal"/>
  <WorkoutRoute sourceName="Watch">
   <MetadataEntry key="HKWeatherHumidity" value="40 %"/>
   <FileReference path="/workout-routes/route_2024-01-05.gpx"/>
  </WorkoutRoute>
 </Workout>
 <Workout workoutActivityType="HKWorkoutActivityTypeYoga" duration="10" startDate="2024-01-06 07:00:00 +0000" endDate="2024-01-06 07:10:00 +0000"/>
 <ActivitySummary dateComponents="2024-01-05" activeEnergyBurned="420.5" activeEnergyBurnedGoal="500" appleExerciseTime="31" appleStandHours="10"/>
 <ActivitySummary activeEnergyBurned="1"/>
</HealthData>
"""


BROKEN_LINE = ' <Record type="HKQuantityTypeIdentifierHeartRate" sourceName="Broken value="9" startDate=\n'
EXPORT_BROKEN = EXPORT.replace(" <Correlation", BROKEN_LINE + " <Correlation")


def write(folder, name="export.xml", text=EXPORT):
    os.makedirs(folder, exist_ok=True)
    p = os.path.join(folder, name)
    with open(p, "w") as fh:
        fh.write(text)
    return p


def test_scan_shapes(spark, tmp):
    p = write(os.path.join(tmp, "carol"), text=EXPORT_BROKEN)
    df = rec.scan_records(spark, p)
    good, bad = rec.split_quarantine(df)
    rows = good.orderBy("start_date_raw", "source_name").collect()
    types = [r["type"] for r in rows]
    assert types.count("HKQuantityTypeIdentifierHeartRate") == 3
    assert "HKQuantityTypeIdentifierBodyMass" in types                  # nested in Correlation
    assert any(r["source_name"] == "Watch & Co" for r in rows)         # entity decoded
    assert any(r["value"] == "55" for r in rows)                        # '>' inside a quoted value
    assert bad.count() == 1                                             # the broken tag


def test_ingest_tables(spark, tmp):
    p = write(os.path.join(tmp, "carol"))
    m = default_manifest()
    store = TableStore(spark, os.path.join(tmp, "store"), m)
    rep = ingest_export(spark, p, store, m)
    # mapped before dedupe: 3 HR + 1 resting + body mass + sleep + steps (unmapped type not counted)
    assert rep.mapped["vitals"] == 4 and rep.mapped["body_metrics"] == 1
    assert rep.quarantined == 0
    v = store.read("vitals")
    # the two 10:00 readings differ only in creationDate/source -> one row (K1)
    assert v.filter(F.col("heart_rate") == 60).count() == 1
    assert v.filter(F.col("heart_rate") == 60).first()["creation_date"].day == 1   # lowest creation wins
    assert store.read("sleep").first()["sleep_stage"] == 5                         # D5 symbolic stage
    steps = store.read("activity").first()
    assert steps["step_count"] == 12 and steps["start_date"] is None               # D3
    w = store.read("workouts").orderBy("start_date").collect()
    assert len(w) == 2
    run = w[0]
    assert run["session_id"] == "2024-01-05 07:00:00 +0000"                        # raw start text
    assert run["active_calories"] == 250.5                                           # last wins
    assert run["basal_calories"] is None
    assert run["humidity"] == "40 %"                                                 # nested metadata
    assert run["route_file"] == "route_2024-01-05.gpx"
    assert w[1]["activity_type"] == "HKWorkoutActivityTypeYoga"                      # self-closing (D7)
    s = store.read("activity_summaries").collect()
    assert len(s) == 2
    dated = [r for r in s if r["date"] == "2024-01-05"][0]
    assert dated["active_energy"] == 420.5 and dated["start_date"].hour == 0         # D16


def test_id_independent_of_partitioning(spark, tmp):
    """Content ids do not depend on how the file is split."""
    from kardia.plans.ingest import prepare_records
    m = default_manifest()
    p = write(os.path.join(tmp, "dave"))
    base = rec.read_record_chunks(spark, p).withColumn("subject_id", F.lit("d")).drop("file_path")
    a, _ = prepare_records(base, m)
    b, _ = prepare_records(base.repartition(7), m)
    assert sorted(r.uuid for r in a.collect()) == sorted(r.uuid for r in b.collect())


def test_mapped_count_parity_with_row_tag(spark, tmp):
    """The text split finds every <Record> the XML source finds."""
    p = write(os.path.join(tmp, "erin"))
    split = rec.split_quarantine(rec.scan_records(spark, p))[0].count()
    tagged = (spark.read.format("xml").option("rowTag", "Record").schema("_type string").load(p)
              .filter(F.col("_type").isNotNull()).count())
    assert split == tagged


def test_broken_xml_keeps_good_records(spark, tmp):
    """A malformed record is quarantined and counted; every
    well-formed record of the same file is still ingested."""
    m = default_manifest()
    p = write(os.path.join(tmp, "fred"), text=EXPORT_BROKEN)
    store = TableStore(spark, os.path.join(tmp, "store"), m)
    rep = ingest_export(spark, p, store, m)
    assert rep.quarantined == 1
    assert rep.mapped["vitals"] == 4
    assert spark.read.parquet(os.path.join(tmp, "store", "_quarantine")).count() == 1


def test_large_load_is_split(spark, tmp):
    """FIXTURES §3 large load: 100,000 records (even: heart rate, odd: steps)
    in one export; with a small split size the scan runs in several tasks
    and every record is ingested."""
    import math
    m = default_manifest()
    folder = os.path.join(tmp, "big")
    os.makedirs(folder)
    path = os.path.join(folder, "export.xml")
    with open(path, "w") as fh:
        fh.write('<?xml version="1.0"?>\n<HealthData>\n')
        for i in range(100_000):
            mm, ss = divmod(i, 60)
            hh, mm = divmod(mm, 60)
            dd, hh = divmod(hh, 24)
            t = f"2024-01-{1 + dd:02d} {hh:02d}:{mm:02d}:{ss:02d} +0000"
            if i % 2 == 0:
                typ, val = "HKQuantityTypeIdentifierHeartRate", f"{60 + math.sin(i * 0.1) * 20 + 20:.4f}"
            else:
                typ, val = "HKQuantityTypeIdentifierStepCount", "15"
            fh.write(f' <Record type="{typ}" sourceName="Gen" startDate="{t}" endDate="{t}" value="{val}"/>\n')
        fh.write("</HealthData>\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        assert rec.read_record_chunks(spark, path).rdd.getNumPartitions() > 4
        store = TableStore(spark, os.path.join(tmp, "store"), m)
        rep = ingest_export(spark, path, store, m)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rep.mapped["vitals"] == 50_000 and rep.mapped["activity"] == 50_000
    assert rep.inserted["vitals"] == 50_000 and rep.inserted["activity"] == 50_000
