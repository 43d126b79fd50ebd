"""The minimum slice: an export of one person goes in, rows and hourly figures come out."""

import os

from pyspark.sql import functions as F

from kardia.manifest import load_manifest
from kardia.operators.aggregate import bucket_aggregate
from kardia.operators.query import table_query
from kardia.plans.ingest import ingest_export
from kardia.plans.store import TableStore

MANIFEST = """
[tables.records]
columns = [
  { name = "heart_rate", data_type = "REAL", aggregate = "avg", hk_type = "HKQuantityTypeIdentifierHeartRate" },
  { name = "flights", data_type = "INTEGER", aggregate = "sum", hk_type = "HKQuantityTypeIdentifierFlightsClimbed" },
]
"""

# (type, minute of 3 March 2023 in a zone two hours ahead, value)
SAMPLES = [("HeartRate", 7 * 60 + 12, "54"), ("HeartRate", 7 * 60 + 48, "63"), ("FlightsClimbed", 7 * 60 + 50, "4"),
           ("HeartRate", 9 * 60 + 5, "71.5"), ("FlightsClimbed", 9 * 60 + 30, "2"), ("FlightsClimbed", 9 * 60 + 31, "3")]


def stamp(minute):
    return f"2023-03-03 {minute // 60:02d}:{minute % 60:02d}:00 +0200"


EXPORT = "<HealthData>\n" + "".join(
    f'<Record type="HKQuantityTypeIdentifier{t}" startDate="{stamp(m)}" endDate="{stamp(m + 1)}" creationDate="{stamp(m + 9)}" value="{v}"/>\n'
    for t, m, v in SAMPLES) + "</HealthData>\n"


def expected():
    """Per UTC hour, mean heart rate and flights, newest first."""
    hours = {}
    for t, m, v in SAMPLES:
        hours.setdefault(m // 60 - 2, []).append((t, float(v)))
    out = []
    for h in sorted(hours, reverse=True):
        beats = [v for t, v in hours[h] if t == "HeartRate"]
        out.append((f"2023-03-03T{h:02d}:00:00Z", sum(beats) / len(beats), int(sum(v for t, v in hours[h] if t != "HeartRate"))))
    return out


def write_export(folder, text=EXPORT, name="export.xml"):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_end_to_end_ingestion(spark, tmp):
    m = load_manifest(MANIFEST)
    path = write_export(os.path.join(tmp, "dora"))
    store = TableStore(spark, os.path.join(tmp, "store"), m)
    report = ingest_export(spark, path, store, m)
    assert report.total_mapped == report.inserted["records"] == len(SAMPLES)
    assert len(table_query(store.read("records"), limit=100).collect()) == len(SAMPLES)
    hours = bucket_aggregate(store.read("records"), "hour", table=m.table("records")).collect()
    assert [(r["time_bucket"], r["heart_rate"], r["flights"]) for r in hours] == expected()
    assert {r["subject_id"] for r in store.read("records").collect()} == {"dora"}


def test_reingest_is_noop(spark, tmp):
    m = load_manifest(MANIFEST)
    path = write_export(os.path.join(tmp, "bob"))
    store = TableStore(spark, os.path.join(tmp, "store"), m)
    ingest_export(spark, path, store, m)
    again = ingest_export(spark, path, store, m)
    assert again.total_mapped == len(SAMPLES)          # K8: counted before dedupe
    assert again.inserted["records"] == 0
    assert store.read("records").count() == len(SAMPLES)


def test_schema_evolution_reads_old_files(spark, tmp):
    """A column added to the manifest reads as NULL for rows stored before."""
    old = load_manifest(MANIFEST)
    path = write_export(os.path.join(tmp, "carl"))
    root = os.path.join(tmp, "store")
    ingest_export(spark, path, TableStore(spark, root, old), old)
    head, _, tail = MANIFEST.rpartition("]")
    new = load_manifest(head + '  { name = "spo2", hk_type = "HKQuantityTypeIdentifierOxygenSaturation", data_type = "REAL" },\n]' + tail)
    rows = TableStore(spark, root, new).read("records").collect()
    assert len(rows) == len(SAMPLES) and all(r["spo2"] is None for r in rows)


def test_many_subjects_at_once(spark, tmp):
    """Exports of several subjects in one ingest: identical records of two
    people are both kept (the subject is part of the key); re-ingesting
    both is a no-op; the run's staging folder is removed after commit."""
    import glob
    m = load_manifest(MANIFEST)
    paths = [write_export(os.path.join(tmp, who)) for who in ("ann", "ben")]
    store = TableStore(spark, os.path.join(tmp, "store"), m)
    rep = ingest_export(spark, paths, store, m)
    assert rep.inserted["records"] == 2 * len(SAMPLES)
    per = {r["subject_id"]: r["n"] for r in store.read("records").groupBy("subject_id").agg(F.count("*").alias("n")).collect()}
    assert per == {"ann": len(SAMPLES), "ben": len(SAMPLES)}
    assert ingest_export(spark, paths, store, m).inserted["records"] == 0
    assert not glob.glob(os.path.join(tmp, "store", "_staging", "*"))   # no staging folder left behind
