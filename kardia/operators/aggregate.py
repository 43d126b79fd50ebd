"""F1–F3 — time-bucket aggregates and biometric trends.

Predicates are on the typed, unwrapped ``start_date`` column so they reach
the Parquet scan (row-group min/max skipping); the bucket label is computed
after the filter. Aggregates are plain built-ins, so Catalyst runs a partial
(map-side) hash aggregate before the single shuffle on the bucket key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kardia.functions.dates import bound, bucket_pattern
from kardia.manifest import Table

_AGG = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def time_range(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    """Inclusive range on a typed column; either bound optional (D4: typed bounds)."""
    lo, hi = bound(start), bound(end)
    if lo is not None:
        df = df.filter(F.col(col) >= lo)
    if hi is not None:
        df = df.filter(F.col(col) <= hi)
    return df


def aggregate_exprs(table: Table | None = None, aggs: dict[str, str] | None = None) -> list[Column]:
    """one aggregate per column whose manifest ``aggregate`` is not raw."""
    pairs = list((aggs or {}).items())
    if table is not None and not pairs:
        pairs = [(c.field_name, c.aggregate) for c in table.columns if c.aggregate != "raw"]
    return [_AGG[a](F.col(name)).alias(name) for name, a in pairs if a in _AGG]


def bucket_aggregate(df: DataFrame, bucket: str, table: Table | None = None,
                     aggs: dict[str, str] | None = None, start=None, end=None,
                     subject_cols: list[str] | tuple[str, ...] = (),
                     time_col: str = "start_date") -> DataFrame:
    """group by the bucket label (hour/day/month), newest first.

    Unparsable (NULL) dates form a NULL bucket, ordered last."""
    pattern = bucket_pattern(bucket)  # validates the bucket name first
    filtered = time_range(df, time_col, start, end)
    grouped = filtered.groupBy(*subject_cols, F.date_trunc(bucket, F.col(time_col)).alias("_start"))
    exprs = aggregate_exprs(table, aggs)
    out = grouped.agg(*exprs) if exprs else grouped.agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    # the label is made per bucket, not per row
    out = out.select(*subject_cols, F.date_format("_start", pattern).alias("time_bucket"), *[c for c in out.columns if c not in (*subject_cols, "_start")])
    return out.orderBy(*subject_cols, F.desc_nulls_last("time_bucket"))


def biometric_trends(df: DataFrame, table: Table, start=None, end=None,
                     subject_cols: list[str] | tuple[str, ...] = (),
                     time_col: str = "start_date") -> DataFrame:
    """avg/min/max of every numeric column in an inclusive range, one row
    (per subject): ``<col>_avg``, ``<col>_min``, ``<col>_max``."""
    exprs = []
    for c in table.columns:
        if c.numeric:
            exprs += [F.avg(c.field_name).alias(f"{c.field_name}_avg"),
                      F.min(c.field_name).alias(f"{c.field_name}_min"),
                      F.max(c.field_name).alias(f"{c.field_name}_max")]
    filtered = time_range(df, time_col, start, end)
    if not exprs:
        return filtered.select(*subject_cols).distinct()
    if subject_cols:
        return filtered.groupBy(*subject_cols).agg(*exprs)
    return filtered.agg(*exprs)
