"""G1, E1, F5 — running values over time-ordered rows of a key, by range partitions.

A window over a key puts all its rows into one task, and one over a key and hour all rows of that hour. Here rows are dealt
into ranges of (key, time, ties), of about equal size whatever the keys and times are; even equal rows are told
apart by the number under which they were read. Running values are then

1. a window inside (key, range), whose rows are bounded by the range's size, and
2. what the earlier ranges of the key hand on: the last row, or the totals. A key lies in several ranges only
   where a range's border cuts it, so these are at most as many rows as there are ranges, and are broadcast.

The ranges are written once below ``spark.checkpoint.dir``: their borders are sampled, and both steps must see the same.
The results equal those of a single window per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from kardia.session import scratch_dir

PART, PLACE = "_part", "_place"
RANGES_PER_TASK = 4  # several ranges a task even out the sampled borders


def in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_place`` (ascending by keys and order) and ``_part``, dealt so that a range is in one task."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.asc_nulls_first(c) for c in [*keys, *order]], F.asc("_line")]
    path = scratch_dir(spark, "ranges")
    lined = df.withColumn("_line", F.monotonically_increasing_id())
    (lined.repartitionByRange(tasks * RANGES_PER_TASK, *by).sortWithinPartitions(*by).drop("_line")
     .withColumn(PLACE, F.monotonically_increasing_id()).write.parquet(path))
    table = spark.read.parquet(path)
    return table.withColumn(PART, F.shiftright(PLACE, 33)).repartitionByRange(tasks, PART)


def _local(keys: list[str]) -> Window:
    return Window.partitionBy(*keys, PART).orderBy(PLACE)


def _with_handed_on(ranged: DataFrame, handed: DataFrame, keys: list[str]) -> DataFrame:
    """Join what earlier ranges hand on, at most one row per range, to a range's rows; NULL keys equal NULL."""
    on = [*keys, PART]
    small = F.broadcast(handed.withColumnsRenamed({c: f"_h{c}" for c in on}))
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_h{c}")) for c in on])
    return ranged.join(small, cond, "left").drop(*[f"_h{c}" for c in on])


def with_previous_row(ranged: DataFrame, keys: list[str], row: Column, name: str) -> DataFrame:
    """Add ``name``: ``row`` of the preceding row of the key (NULL for its first)."""
    last = ranged.groupBy(*keys, PART).agg(F.max_by(row, PLACE).alias("_last"))
    earlier = F.lag("_last").over(Window.partitionBy(*keys).orderBy(PART))
    handed = last.select(*keys, PART, earlier.alias("_handed")).filter(F.col("_handed").isNotNull())
    local = ranged.withColumn(name, F.lag(row).over(_local(keys)))
    return _with_handed_on(local, handed, keys).withColumn(name, F.coalesce(name, "_handed")).drop("_handed")


def with_running_sums(ranged: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Add, under each name, the sum of a value (never NULL) over the key's rows up to this one."""
    totals = ranged.groupBy(*keys, PART).agg(*[F.sum(v).alias(f"_t{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    handed = totals.select(*keys, PART, *[F.sum(f"_t{n}").over(earlier).alias(f"_e{n}") for n in values])
    handed = handed.filter(reduce(lambda a, b: a | b, [F.col(f"_e{n}").isNotNull() for n in values]))
    up_to = _local(keys).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(v).over(up_to).alias(n) for n, v in values.items()])
    met = _with_handed_on(local, handed, keys)
    return met.withColumns({n: F.col(n) + F.coalesce(f"_e{n}", F.lit(0)) for n in values}).drop(*[f"_e{n}" for n in values])
