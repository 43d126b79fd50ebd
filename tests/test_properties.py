"""Hypothesis property tests: fold = loop, counts = naive."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings, strategies as st

from kardia.functions import signal as sig
from kardia.operators.intervals import interval_point_counts

from test_ecg_external import loop_hr

T0 = datetime(2024, 1, 1)
SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.lists(st.integers(-50, 50), max_size=80), min_size=1, max_size=6),
       st.sampled_from([1.0, 10.0, 15.0, 512.0]))
def test_peak_fold_equals_loop(spark, signals, rate):
    rows = [(i, [float(v) for v in s], rate) for i, s in enumerate(signals)]
    df = spark.createDataFrame(rows, "k int, x array<double>, r double")
    got = {r["k"]: (r["n"], r["hr"]) for r in df.select(
        "k", sig.peak_scan("x", "r")["n"].alias("n"), sig.ecg_heart_rate("x", "r").alias("hr")).collect()}
    for k, x, r in rows:
        hr, peaks = loop_hr(x, r)
        assert got[k] == (len(peaks), hr)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 600)), max_size=60),
       st.lists(st.tuples(st.integers(0, 3), st.integers(-10, 600), st.integers(-20, 200)), min_size=1, max_size=12))
def test_interval_counts_equal_naive(spark, pts, ivs):
    p = spark.createDataFrame([(str(k), T0 + timedelta(minutes=m)) for k, m in pts] or [("x", None)],
                              "k string, t timestamp")
    i = spark.createDataFrame([(f"s{j}", str(k), T0 + timedelta(minutes=s), T0 + timedelta(minutes=s + d))
                               for j, (k, s, d) in enumerate(ivs)], "sid string, k string, s timestamp, e timestamp")
    got = {r["sid"]: r["n"] for r in interval_point_counts(i, p, "sid", "s", "e", "t", equi_cols=["k"]).collect()}
    for j, (k, s, d) in enumerate(ivs):
        want = sum(1 for pk, m in pts if pk == k and d >= 0 and s <= m <= s + d)
        assert got[f"s{j}"] == want
