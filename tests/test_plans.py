"""Driver contract + physical-plan properties of the registered queries."""

import pytest

import __spark_entry__ as entry
from kardia.plans import registry

registry.load_all()

SF = "/root/testdata/sf0.001"
STREAMING = {"ingest_counts", "stream_ingest", "stream_dedupe", "stream_new_files", "stream_bucket_hour", "stream_ingest_workouts"}


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[0] == "time_bucket"


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - STREAMING))
def test_plans_stay_on_the_jvm(spark, name):
    """No Python UDF in any plan; no nested-loop or cartesian join."""
    plan = plan_of(entry.queries()[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "BroadcastNestedLoopJoin", "CartesianProduct"):
        assert bad not in plan, f"{name}: {bad}"


@pytest.mark.parametrize("name", ["bucket_range", "trends", "table_query_range", "date_prefix_filter", "recovery_score"])
def test_time_range_reaches_the_stored_files(spark, name):
    """Time ranges are pushed to the Parquet reader of the stored table, and only the columns asked for are read."""
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "GreaterThanOrEqual(start_date,2024-01-" in plan
    if name != "recovery_score":
        assert "LessThan" in plan[plan.index("PushedFilters"):]
    assert "uuid" not in plan[plan.index("ReadSchema"):].split("\n")[0]


def test_a_stored_table_skips_days(spark, tmp):
    """Rows are sorted by time in each bucket file, so a range on the store's own read is pushed, too."""
    from pyspark.sql import functions as F
    from kardia.plans import bridge
    df = bridge.stored_vitals(spark, SF).filter(F.col("start_date") >= F.lit("2024-01-20").cast("timestamp")).select("heart_rate")
    assert "GreaterThanOrEqual(start_date,2024-01-20" in plan_of(df) and df.count() > 0


def test_streaming_equals_batch(spark):
    """(d) streaming run (twice, with re-exported duplicates) = batch run once."""
    from kardia.plans.catalog_analytics import vitals
    from pyspark.sql import functions as F
    s = entry.queries()["stream_dedupe"](spark, SF)
    b = vitals(spark, SF).select("subject_id", F.date_format("start_date", "yyyy-MM-dd HH:mm:ss").alias("start_date"),
                                 F.date_format("end_date", "yyyy-MM-dd HH:mm:ss").alias("end_date"),
                                 F.round("heart_rate", 4).alias("heart_rate"), F.round("hrv_sdnn", 4).alias("hrv_sdnn"),
                                 F.round("resting_hr", 4).alias("resting_hr")).distinct()
    assert s.count() == b.count()
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0
