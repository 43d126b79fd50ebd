"""F4–F6, H2–H6, H8 — workout intensity, sleep breakdown, recovery score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kardia.functions.dates import bound
from kardia.functions.scalars import (ZONE_NAMES, clamp_round, hr_zone, interval_seconds,
                                      recovery_status, sleep_stage_label)
from kardia.manifest import default_manifest
from kardia.operators.intervals import interval_point_counts, join_keys, subject_keys


# ---- F5 heart-rate zones ----------------------------------------------------

def hr_zone_histogram(workouts: DataFrame, samples: DataFrame, max_hr: float | None = None,
                      session_col: str = "session_id", hr_col: str = "heart_rate",
                      time_col: str = "start_date", subject_cols: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    """Per (subject, workout): samples with ``hr > 0`` and ``start <= t <= end`` by zone
    (all five present, 0 if empty) plus the sample count and max HR used
    (``max_hr``, by default that of the shipped manifest's profile).

    Counting uses :func:`interval_point_counts` (no session × sample pairs)."""
    subject_cols = subject_keys(subject_cols, workouts, samples)
    max_hr = default_manifest().max_heart_rate if max_hr is None else max_hr
    s = samples.filter(F.col(hr_col) > 0).select(
        *subject_cols, F.col(time_col).alias("_t"), hr_zone(F.col(hr_col), max_hr).alias("_zone"))
    w = workouts.select(*subject_cols, session_col, F.col("start_date").alias("_s"), F.col("end_date").alias("_e"))
    counts = interval_point_counts(w, s, session_col, "_s", "_e", "_t", category_col="_zone",
                                   categories=ZONE_NAMES, equi_cols=subject_cols)
    return counts.select(*subject_cols, session_col, F.col("n").alias("sample_count"),
                         F.lit(float(max_hr)).alias("max_hr_used"),
                         *[F.col(f"n_{z}").alias(z) for z in ZONE_NAMES])


# ---- F6 sleep ------------------------------------------------------------------

def sleep_intervals(sleep: DataFrame, day: str | None = None, subject_cols: list[str] | tuple[str, ...] = (),
                    stage_col: str = "sleep_stage") -> DataFrame:
    """Stage label, UTC start day and whole-second duration of every interval.

    D5: rows without a stage (the sleep table's other metrics) are excluded;
    rows whose dates do not parse are skipped; negative durations are kept."""
    s = sleep.filter(F.col(stage_col).isNotNull() & F.col("start_date").isNotNull()
                     & F.col("end_date").isNotNull())
    if day is not None:
        lo = bound(day)
        s = s.filter((F.col("start_date") >= lo) & (F.col("start_date") < F.timestamp_add("DAY", F.lit(1), lo)))
    return s.select(*subject_cols, F.date_format("start_date", "yyyy-MM-dd").alias("date"),
                    sleep_stage_label(F.col(stage_col)).alias("stage"),
                    interval_seconds(F.col("start_date"), F.col("end_date")).cast("double").alias("seconds"))


def sleep_breakdown(sleep: DataFrame, day: str | None = None,
                    subject_cols: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Seconds per (subject…, date, stage label)."""
    iv = sleep_intervals(sleep, day, subject_cols)
    return iv.groupBy(*subject_cols, "date", "stage").agg(F.sum("seconds").alias("seconds"))


def sleep_total_hours(sleep: DataFrame, day: str | None = None,
                      subject_cols: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """K4: total hours over **all** stages (In Bed and Awake included), plus the
    hours in asleep stages (Asleep/Core/Deep/REM) per (subject…, date)."""
    iv = sleep_intervals(sleep, day, subject_cols)
    asleep = F.col("stage").isin("Asleep", "Core", "Deep", "REM")
    return iv.groupBy(*subject_cols, "date").agg(
        (F.sum("seconds") / 3600.0).alias("total_sleep_hours"),
        (F.coalesce(F.sum(F.when(asleep, F.col("seconds"))), F.lit(0.0)) / 3600.0).alias("asleep_hours"))


# ---- F4 recovery -------------------------------------------------------------

def _score(hrv_base, hrv_cur, rhr_base, rhr_cur):
    score = F.when(hrv_base > 0, hrv_cur / hrv_base * 100.0).otherwise(F.lit(0.0))
    score = F.when((rhr_cur > rhr_base) & (rhr_base > 0), score - (rhr_cur - rhr_base) * 5.0).otherwise(score)
    final = clamp_round(score)
    return final, recovery_status(final)


def recovery_score(vitals: DataFrame, as_of: str, subject_cols: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per subject: 7-day baselines vs since-yesterday averages of HRV
    and resting HR in ONE scan (conditional averages).

    Windows start at UTC midnight ``as_of - 7`` / ``as_of - 1`` days and have
    no upper bound (K3); empty averages are 0.0, so a subject without rows in the
    window scores 0. Subjects come from a scan of the key columns alone; the
    values are read from the window's time range only."""
    d = F.to_date(F.lit(as_of))
    since7 = F.to_timestamp(F.date_sub(d, 7))
    since1 = F.to_timestamp(F.date_sub(d, 1))
    hrv, rhr, t = F.col("hrv_sdnn"), F.col("resting_hr"), F.col("start_date")
    # only rows of the widest window can contribute: pushable pre-filter
    rows = vitals.filter((t >= since7) & ((hrv > 0) | (rhr > 0)))
    exprs = [
        F.coalesce(F.avg(F.when((hrv > 0), hrv)), F.lit(0.0)).alias("hrv_baseline"),
        F.coalesce(F.avg(F.when((hrv > 0) & (t >= since1), hrv)), F.lit(0.0)).alias("hrv_current"),
        F.coalesce(F.avg(F.when((rhr > 0), rhr)), F.lit(0.0)).alias("rhr_baseline"),
        F.coalesce(F.avg(F.when((rhr > 0) & (t >= since1), rhr)), F.lit(0.0)).alias("rhr_current"),
    ]
    if subject_cols:
        zeros = {c: 0.0 for c in ("hrv_baseline", "hrv_current", "rhr_baseline", "rhr_current")}
        agg = join_keys(vitals.select(*subject_cols).distinct(), rows.groupBy(*subject_cols).agg(*exprs),
                         list(subject_cols)).fillna(zeros)
    else:
        agg = rows.agg(*exprs)
    final, status = _score(F.col("hrv_baseline"), F.col("hrv_current"), F.col("rhr_baseline"), F.col("rhr_current"))
    return agg.select(*subject_cols, final.alias("recovery_score"), status.alias("status"),
                      "hrv_baseline", "hrv_current", "rhr_baseline", "rhr_current")


def recovery_daily(vitals: DataFrame, subject_cols: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Recovery for every (subject, day) as ``as_of``, set-based.

    Rows are first reduced to daily partial sums/counts (map-side combined);
    the windows ``[as_of-7, as_of]`` / ``[as_of-1, as_of]`` are then range frames in
    days over the *daily* rows (one per subject-day) — raw rows are never
    windowed, and later rows never change an earlier day."""
    hrv, rhr = F.col("hrv_sdnn"), F.col("resting_hr")
    daily = vitals.filter(F.col("start_date").isNotNull()).groupBy(
        *subject_cols, F.to_date("start_date").alias("day")).agg(
        F.sum(F.when(hrv > 0, hrv)).alias("hs"), F.count(F.when(hrv > 0, hrv)).alias("hc"),
        F.sum(F.when(rhr > 0, rhr)).alias("rs"), F.count(F.when(rhr > 0, rhr)).alias("rc"))
    dn = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    daily = daily.withColumn("_dn", dn)
    w7 = Window.partitionBy(*subject_cols).orderBy("_dn").rangeBetween(-7, 0)
    w1 = Window.partitionBy(*subject_cols).orderBy("_dn").rangeBetween(-1, 0)

    def avg_over(s, c, w):
        return F.when(F.sum(c).over(w) > 0, F.sum(s).over(w) / F.sum(c).over(w)).otherwise(F.lit(0.0))

    x = daily.select(*subject_cols, "day",
                     avg_over("hs", "hc", w7).alias("hrv_baseline"), avg_over("hs", "hc", w1).alias("hrv_current"),
                     avg_over("rs", "rc", w7).alias("rhr_baseline"), avg_over("rs", "rc", w1).alias("rhr_current"))
    final, status = _score(F.col("hrv_baseline"), F.col("hrv_current"), F.col("rhr_baseline"), F.col("rhr_current"))
    return x.select(*subject_cols, F.date_format("day", "yyyy-MM-dd").alias("as_of"),
                    final.alias("recovery_score"), status.alias("status"),
                    "hrv_baseline", "hrv_current", "rhr_baseline", "rhr_current")
