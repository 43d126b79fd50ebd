"""Q1–Q7, C6, C7, F7, F8 — table queries, lookups, exports and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kardia.functions.dates import bound
from kardia.operators.aggregate import time_range


class QueryError(ValueError):
    pass


def check_column(df: DataFrame, name: str) -> str:
    """A caller-supplied column name must exist (never pasted into SQL)."""
    if name not in df.columns:
        raise QueryError(f"unknown column {name!r}")
    return name


def table_query(df: DataFrame, sort: str = "start_date", limit: int | None = 100,
                start=None, end=None, tie_break: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Q1–Q3: rows with ``start <= sort <= end`` (bounds optional, K6), newest
    first (NULLs last), first ``limit`` rows (None = all).

    ``sort + limit`` plans as ``TakeOrderedAndProject``: each task keeps its
    own top ``limit`` and only those reach the final merge."""
    check_column(df, sort)
    for c in tie_break:
        check_column(df, c)
    dtype = df.schema[sort].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        out = time_range(df, sort, start, end)
    else:
        out = df
        if start is not None:
            out = out.filter(F.col(sort) >= F.lit(start).cast(dtype))
        if end is not None:
            out = out.filter(F.col(sort) <= F.lit(end).cast(dtype))
    out = out.orderBy(F.desc_nulls_last(sort), *[F.desc_nulls_last(c) for c in tie_break])
    return out.limit(limit) if limit is not None else out


def date_prefix_filter(df: DataFrame, day: str, col: str = "start_date") -> DataFrame:
    """Q6: rows whose timestamp falls on ``day`` (UTC), as a pushable range."""
    lo = bound(day)
    hi = F.timestamp_add("DAY", F.lit(1), lo)
    return df.filter((F.col(col) >= lo) & (F.col(col) < hi))


def lookup(df: DataFrame, key_col: str, value) -> DataFrame:
    """Q7: point lookup; an absent key is an empty result, not an error."""
    check_column(df, key_col)
    return df.filter(F.col(key_col) == F.lit(value))


def rows_to_json(df: DataFrame, alias: str = "json") -> DataFrame:
    """Each row as one JSON object; NULL fields kept as ``null``."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(alias))


def _csv_field(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # shortest float text, integral values without ".0" (60.0 -> 60)
        txt = F.when((c == F.floor(c)) & (F.abs(c) < F.lit(1e15)), c.cast("long").cast("string")) \
               .otherwise(c.cast("string"))
    else:
        txt = c.cast("string")
    txt = F.coalesce(txt, F.lit(""))
    needs_quote = txt.rlike(r'[",\r\n]')
    return F.when(needs_quote, F.concat(F.lit('"'), F.regexp_replace(txt, '"', '""'), F.lit('"'))) \
            .otherwise(txt)


def csv_lines(df: DataFrame, alias: str = "line") -> DataFrame:
    """C6 text form: one CSV line per row, NULL -> empty, RFC 4180 quoting."""
    fields = [_csv_field(F.col(f.name), f.dataType) for f in df.schema.fields]
    return df.select(F.concat_ws(",", *fields).alias(alias))


def csv_header(df: DataFrame) -> str:
    return ",".join(df.columns)


def export_csv(df: DataFrame, path: str) -> None:
    """Distributed CSV export (NULL as empty, no ordering): the lines of :func:`csv_lines` as text
    part files; the first one holds the header alone, so the parts in order of name are one CSV file."""
    header = df.sparkSession.createDataFrame([(csv_header(df),)], "line string").coalesce(1)
    header.union(csv_lines(df)).write.mode("overwrite").text(path)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """one row per table with its row count, as a single union plan (rows are
    scanned without columns)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def table_footprint(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """F8: bytes on disk per table, from a listing of its files (no content is read)."""
    parts = []
    for name, path in paths.items():
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
                 .load(path).select(F.col("length").alias("s")))
        parts.append(files.agg(F.lit(name).alias("table_name"),
                               F.count(F.lit(1)).alias("file_count"),
                               F.coalesce(F.sum("s"), F.lit(0)).alias("bytes")))
    return reduce(DataFrame.unionByName, parts)
