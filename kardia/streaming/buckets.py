"""I4 — live time buckets with bounded state.

The state of a bucket is what its aggregates merge from: sum, count, least and greatest value of each column. A micro-batch
reduces the rows that it has *newly stored* (the store has dropped the others, so a re-export counts once) to one partial
row per bucket, merges them with the stored buckets of the same days, and overwrites those days' partitions. The state is one
row per bucket, however many rows or batches there were, and a batch reads and writes the days it touches only. Late rows count.

The merged days are written aside first; a batch that fails while overwriting is overwritten again from there, and the
name of the last batch merged tells a replay that it has nothing to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kardia.functions.dates import bucket_pattern
from kardia.plans.batches import delete_path, path_exists, read_text, write_text

DAY = "_day"
NO_DAY = "none"  # the partition of rows without a time

_PARTS = {"sum": F.sum, "n": F.count, "min": F.min, "max": F.max}
_MERGE = {"sum": F.sum, "n": F.sum, "min": F.min, "max": F.max}
_NEEDS = {"avg": ("sum", "n"), "sum": ("sum",), "count": ("n",), "min": ("min",), "max": ("max",)}


def _final(column: str, agg: str) -> Column:
    part = lambda p: F.col(f"_{p}_{column}")
    if agg == "avg":
        return F.when(part("n") > 0, part("sum") / part("n"))
    return part(_NEEDS[agg][0])


class LiveBuckets:
    def __init__(self, spark: SparkSession, path: str, bucket: str, aggs: dict[str, str],
                 subject_cols: list[str] | tuple[str, ...] = (), time_col: str = "start_date"):
        unknown = set(aggs.values()) - set(_NEEDS)
        if unknown:
            raise ValueError(f"aggregates that don't merge: {sorted(unknown)}")
        self.spark, self.path, self.bucket, self.aggs = spark, path.rstrip("/"), bucket, dict(aggs)
        self.pattern = bucket_pattern(bucket)
        self.keys, self.time_col = list(subject_cols), time_col
        self.parts = [(c, p) for c, a in self.aggs.items() for p in _NEEDS[a]]

    def partials(self, rows: DataFrame) -> DataFrame:
        """One row per bucket of ``rows``."""
        start = F.date_trunc(self.bucket, F.col(self.time_col)).alias("_start")
        out = rows.groupBy(*self.keys, start).agg(*[_PARTS[p](c).alias(f"_{p}_{c}") for c, p in self.parts])
        return out.withColumn(DAY, F.coalesce(F.date_format("_start", "yyyy-MM-dd"), F.lit(NO_DAY)))

    def _merged(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.keys, "_start", DAY).agg(*[_MERGE[p](f"_{p}_{c}").alias(f"_{p}_{c}") for c, p in self.parts])

    def merge(self, rows: DataFrame, batch: str) -> None:
        """Add a batch's new rows; a batch that is merged already is left alone."""
        last, aside = f"{self.path}_merged/last", f"{self.path}_merged/{batch}"
        if path_exists(self.spark, last) and read_text(self.spark, last) == batch:
            return
        if not path_exists(self.spark, f"{aside}/_SUCCESS"):
            new = self.partials(rows)
            if path_exists(self.spark, self.path):
                state = self.spark.read.schema(new.schema).parquet(self.path)
                new = new.unionByName(state.join(new.select(DAY).distinct(), DAY, "left_semi").select(*new.columns))
            self._merged(new).write.mode("overwrite").parquet(aside)
        merged = self.spark.read.parquet(aside)
        label = F.date_format("_start", self.pattern).alias("time_bucket")
        final = merged.select(*self.keys, label, *[_final(c, a).alias(c) for c, a in self.aggs.items()], "_start", *[f"_{p}_{c}" for c, p in self.parts], DAY)
        # as many files as days: a day's buckets are bounded by the subjects
        (final.repartition(DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(self.path))
        write_text(self.spark, last, batch)
        delete_path(self.spark, aside)

    def read(self) -> DataFrame:
        """``(subject…, time_bucket, <aggregates>)``."""
        return self.spark.read.parquet(self.path).select(*self.keys, "time_bucket", *self.aggs)
