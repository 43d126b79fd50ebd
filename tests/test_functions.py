import math

import pytest
from pyspark.sql import functions as F

from kardia.functions import dates as D
from kardia.functions import scalars as S


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_normalize_date(spark):
    assert one(spark, D.normalize_date(F.lit("2024-01-01 10:00:00 -0500"))) == "2024-01-01T15:00:00+00:00"
    assert one(spark, D.normalize_date(F.lit("yesterday"))) == "yesterday"     # passthrough
    assert one(spark, D.parse_export_date(F.lit("yesterday"))) is None


def test_bucket_labels(spark):
    ts = F.lit("2024-03-05 07:45:12").cast("timestamp")
    assert one(spark, D.time_bucket(ts, "hour")) == "2024-03-05T07:00:00Z"
    assert one(spark, D.time_bucket(ts, "day")) == "2024-03-05"
    assert one(spark, D.time_bucket(ts, "month")) == "2024-03"
    with pytest.raises(ValueError):
        D.time_bucket(ts, "week")


@pytest.mark.parametrize("hr,zone", [(113.9, "Z1_Recovery"), (114, "Z2_Aerobic"), (133, "Z3_Steady"),
                                     (152, "Z4_Threshold"), (170.9, "Z4_Threshold"), (171, "Z5_Anaerobic")])
def test_hr_zone_boundaries(spark, hr, zone):
    assert one(spark, S.hr_zone(F.lit(float(hr)), 190.0)) == zone


def test_labels_and_bands(spark):
    assert [one(spark, S.sleep_stage_label(F.lit(i))) for i in range(7)] == \
        ["In Bed", "Asleep", "Awake", "Core", "Deep", "REM", "Unknown"]
    assert one(spark, S.sleep_stage_code(F.lit("HKCategoryValueSleepAnalysisAsleepREM"))) == 5
    assert one(spark, S.sleep_stage_code(F.lit("3"))) == 3
    assert [one(spark, S.recovery_status(F.lit(v))) for v in (81, 80, 51, 31, 30)] == \
        ["Optimal", "Good", "Good", "Strained", "Recovery Needed"]
    assert one(spark, S.clamp_round(F.lit(2.5))) == 3
    assert one(spark, S.clamp_round(F.lit(140.0))) == 100
    assert one(spark, S.clamp_round(F.lit(-3.0))) == 0


def test_interval_seconds_truncates(spark):
    s = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert one(spark, S.interval_seconds(s, F.lit("2024-01-01 00:00:01.9").cast("timestamp"))) == 1
    assert one(spark, S.interval_seconds(F.lit("2024-01-01 00:10:00").cast("timestamp"), s)) == -600


def test_haversine(spark):
    d = one(spark, S.haversine_m(F.lit(47.3769), F.lit(8.5417), F.lit(47.5596), F.lit(7.5886)))
    assert math.isclose(d, 74_466.0, rel_tol=1e-3)  # Zurich to Basel
    assert one(spark, S.haversine_m(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))) == 0.0


def test_base_name_and_casts(spark):
    assert one(spark, S.base_name(F.lit("/private/var/route_1.gpx"))) == "route_1.gpx"
    assert one(spark, S.base_name(F.lit("route_1.gpx"))) == "route_1.gpx"
    assert one(spark, S.typed_cast(F.lit("15.5"), "INTEGER")) is None            # D15
    assert one(spark, S.typed_cast(F.lit("15"), "INTEGER")) == 15
    assert one(spark, S.typed_cast(F.lit(""), "REAL")) is None                  # D2
    assert one(spark, S.typed_cast(F.lit("a&b"), "TEXT")) == "a&b"


def test_content_id_matches_python(spark):
    import hashlib
    parts = ["vitals", "heart_rate", "2024-01-01T15:00:00+00:00", "", "60"]
    expect = hashlib.sha256("".join(parts).encode()).hexdigest()
    got = one(spark, S.content_id(*[F.lit(p) for p in parts[:3]], F.lit(None).cast("string"), F.lit("60")))
    assert got == expect
