"""E2 — interval ⋈ point range join (``start <= t <= end``), two ways.

:func:`range_join` returns the matching pairs. Catalyst has no range-join
strategy and would pick a broadcast nested-loop join; instead time is cut into dyadic intervals (a unit, two
units, four …). An interval lies in at most two neighbouring ones of the size next to its own length, whatever
that is; a point lies in one of each size that occurs. The join is an equi-join
on ``(equi keys…, size, number)`` with the range as a residual predicate. A wrong end date, centuries away, costs two rows and one
more size.

:func:`interval_point_counts` answers "how many points (per category) fall in
each interval" without producing pairs at all: the count is
``N(t <= end) - N(t < start)``, where ``N`` is a running count over the
time-sorted union of points and interval boundaries, taken over ranges of equal size
(:mod:`kardia.operators.prefix`), so neither a hot key nor a dense interval set
makes one task hold everything, and the cost is a sort, not pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kardia.manifest import SUBJECT
from kardia.operators.prefix import in_ranges, with_running_sums

Cols = list[str] | tuple[str, ...]
_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}


def _unit(t: Column, unit: str) -> Column:
    """Number of the unit of time that holds an instant."""
    return F.floor(F.unix_micros(t) / F.lit(_SECONDS[unit] * 1_000_000)).cast("long")


def covered(intervals: DataFrame, start_col: str, end_col: str, bin_unit: str) -> DataFrame:
    """Each interval with the one or two dyadic intervals that cover it: ``_size`` (power of two of the unit) and ``_node``.

    Intervals with NULL bounds or ``end < start`` have none."""
    iv = intervals.filter(F.col(start_col).isNotNull() & F.col(end_col).isNotNull() & (F.col(end_col) >= F.col(start_col)))
    first, last = _unit(F.col(start_col), bin_unit), _unit(F.col(end_col), bin_unit)
    size = F.when(last - first > 1, F.length(F.bin(last - first - 1))).otherwise(F.lit(0))
    iv = iv.select("*", size.alias("_size"), first.alias("_first"), last.alias("_last"))
    nodes = F.array_distinct(F.array(F.expr("shiftright(_first, _size)"), F.expr("shiftright(_last, _size)")))
    return iv.withColumn("_node", F.explode(nodes)).drop("_first", "_last")


def range_join(intervals: DataFrame, points: DataFrame, start_col: str, end_col: str, time_col: str,
               equi_cols: Cols | None = None, bin_unit: str = "day") -> DataFrame:
    """Pairs (interval row, point row) with ``start <= t <= end`` (both inclusive).

    Intervals with NULL bounds or ``end < start`` match nothing. Column names of the two sides
    must be disjoint apart from ``equi_cols``, which default to the subject
    where both sides have one. ``bin_unit`` is the least size; it should be about as long as a short
    interval. The sizes that occur (64 at most) are looked up first."""
    equi_cols = subject_keys(equi_cols, intervals, points)
    iv = covered(intervals, start_col, end_col, bin_unit)
    sizes = sorted(iv.agg(F.collect_set("_size").alias("s")).first()["s"])
    unit = _unit(F.col(time_col), bin_unit)
    pt = points.filter(F.col(time_col).isNotNull()).select(
        "*", F.explode(F.array(*[F.lit(s) for s in sizes]).cast("array<int>")).alias("_size"), unit.alias("_unit"))
    pt = pt.withColumn("_node", F.expr("shiftright(_unit, _size)")).drop("_unit")
    keys = [*equi_cols, "_size", "_node"]
    cond = reduce(lambda a, b: a & b, [iv[k] == pt[k] for k in keys]) \
        & (pt[time_col] >= iv[start_col]) & (pt[time_col] <= iv[end_col])
    joined = iv.join(pt, cond, "inner")
    out_cols = [iv[c] for c in intervals.columns] + [pt[c] for c in points.columns if c not in equi_cols]
    return joined.select(*out_cols)


def interval_point_counts(intervals: DataFrame, points: DataFrame, id_col: str, start_col: str,
                          end_col: str, time_col: str, category_col: str | None = None,
                          categories: tuple[str, ...] = (), equi_cols: Cols | None = None,
                          value_col: str | None = None) -> DataFrame:
    """Per (keys…, interval id): ``n`` = points with ``start <= t <= end``; for each
    category, ``n_<category>``; with ``value_col``, ``total`` = the sum of its values.

    Every interval appears (zeros if none); ids need to be unique within the
    keys only. NULL keys match each other."""
    equi = list(subject_keys(equi_cols, intervals, points))
    cats = list(categories)
    is_point = F.col("_kind") == 1
    counters = {"_c": F.when(is_point, 1).otherwise(0)}
    counters |= {f"_c{i}": F.when(is_point & (F.col(category_col) == c), 1).otherwise(0) for i, c in enumerate(cats)}
    if value_col:
        counters["_cv"] = F.coalesce(F.when(is_point, F.col("_value")), F.lit(0))
    value = [F.col(value_col).alias("_value")] if value_col else []
    no_value = [F.lit(None).cast(points.schema[value_col].dataType).alias("_value")] if value_col else []
    pts = points.filter(F.col(time_col).isNotNull()).select(
        *equi, F.col(time_col).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_id"),
        F.lit(0).alias("_sign"), *([F.col(category_col)] if category_col else []), *value)
    valid = intervals.filter(F.col(start_col).isNotNull() & F.col(end_col).isNotNull()
                             & (F.col(end_col) >= F.col(start_col)))

    def marks(at: str, kind: int, sign: int) -> DataFrame:
        # an open marker sorts before points at the same instant (counts t < start), a close marker after them (counts t <= end)
        return valid.select(*equi, F.col(at).alias("_t"), F.lit(kind).alias("_kind"), F.col(id_col).cast("string").alias("_id"), F.lit(sign).alias("_sign"),
                            *([F.lit(None).cast("string").alias(category_col)] if category_col else []), *no_value)

    u = pts.unionByName(marks(start_col, 0, -1)).unionByName(marks(end_col, 2, 1))
    running = with_running_sums(in_ranges(u, equi, ["_t", "_kind"]), equi, counters)
    signed = running.filter(F.col("_kind") != 1).groupBy(*equi, "_id").agg(*[F.sum(F.col("_sign") * F.col(n)).alias(n) for n in counters])
    out_names = ["n"] + [f"n_{c}" for c in cats] + (["total"] if value_col else [])
    res = signed.select(*equi, "_id", *[F.col(n).alias(o) if o == "total" else F.col(n).cast("long").alias(o)
                                        for n, o in zip(counters, out_names)])
    base = intervals.select(*equi, F.col(id_col), F.col(id_col).cast("string").alias("_id"))
    return join_keys(base, res, [*equi, "_id"]).select(
        *equi, id_col, *[F.coalesce(F.col(o), F.lit(0)).alias(o) for o in out_names])


def subject_keys(given: Cols | None, *tables: DataFrame) -> Cols:
    """The given key columns; by default the subject, where every table has it (a table of one person may lack it)."""
    if given is not None:
        return given
    return (SUBJECT,) if all(SUBJECT in t.columns for t in tables) else ()


def join_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe equality of ``keys``, keeping the left side's keys."""
    renamed = right.select(*[F.col(c).alias(f"_k{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_k{k}"]) for k in keys])
    return left.join(renamed, cond, "left").drop(*[f"_k{k}" for k in keys])
