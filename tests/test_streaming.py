"""Structured Streaming: live buckets = batch buckets; in-stream dedupe; Q3/D12."""

import os

import pytest
from pyspark.sql import functions as F

from kardia.manifest import default_manifest
from kardia.operators.aggregate import bucket_aggregate
from kardia.operators.query import QueryError, table_query
from kardia.streaming import ingest as sing

RECS = "\n".join(
    f'<Record type="HKQuantityTypeIdentifierHeartRate" sourceName="W" startDate="2024-01-01 {h:02d}:{m:02d}:00 +0000" '
    f'endDate="2024-01-01 {h:02d}:{m:02d}:30 +0000" value="{60 + h + m}"/>'
    for h in range(0, 5) for m in (0, 20, 40))


def test_bucket_stream_equals_batch(spark, tmp):
    m = default_manifest()
    folder = os.path.join(tmp, "exports", "subject=s1")
    os.makedirs(folder)
    with open(os.path.join(folder, "export.xml"), "w") as fh:
        fh.write("<HealthData>\n" + RECS + "\n</HealthData>\n")
    out, ckpt = os.path.join(tmp, "out"), os.path.join(tmp, "ckpt")
    aggs = {"heart_rate": "avg"}
    sing.run_bucket_stream(spark, os.path.join(tmp, "exports"), m, "vitals", "hour", aggs, out, ckpt)
    live = {r["time_bucket"]: r["heart_rate"] for r in spark.read.parquet(out).collect()}
    from kardia.plans.ingest import prepare_records
    from kardia.operators.routing import wide_projection
    from kardia.sources.records import read_record_chunks
    ch = read_record_chunks(spark, os.path.join(tmp, "exports")).withColumn("subject_id", F.lit("s1")).drop("file_path")
    rows = wide_projection(prepare_records(ch, m)[0], m.table("vitals"))
    batch = {r["time_bucket"]: r["heart_rate"] for r in bucket_aggregate(rows, "hour", aggs=aggs).collect()}
    assert live == batch and len(batch) == 5


def test_dedupe_stream_options(spark, tmp):
    src = os.path.join(tmp, "src")
    os.makedirs(src)
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int").write.parquet(os.path.join(src, "p1"))
    stream = spark.readStream.schema("k string, v int").parquet(os.path.join(src, "p1"))
    q = (sing.dedupe_stream(stream, ["k"]).writeStream.format("memory").queryName("dd_test")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.sql("SELECT count(*) AS n FROM dd_test").first()["n"] == 2


def test_table_query_nulls_last_and_validation(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 7.0)], "id int, v double")
    assert [r["id"] for r in table_query(df, sort="v", limit=None).collect()] == [3, 2, 1]
    assert [r["id"] for r in table_query(df, sort="v", limit=2).collect()] == [3, 2]
    assert [r["id"] for r in table_query(df, sort="v", start=6, limit=None).collect()] == [3]
    with pytest.raises(QueryError):
        table_query(df, sort="v; DROP TABLE x")
