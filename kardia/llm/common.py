"""Helpers shared by the document operators: table access, shared scratch tables, Arrow row mapping.

Every operator takes a DataFrame of documents and the names of its id and text
columns; it selects just those, so extra or clashing columns never reach it.
A null text counts as the empty text everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from kardia.session import scratch_dir as scratch

# Rows and bytes of one Arrow batch handed to a Python worker; bounds its memory.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` of a document table, null texts as empty ones."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as a scratch table and read it back: computed once, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, purpose)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the scratch tables behind DataFrames of :func:`materialise` that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small, so a worker holds a few megabytes of text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list] | list[dict]], schema: str | StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``: columns in, columns (lists or arrays) or a list of rows out."""
    bounded_batches(df.sparkSession, rows)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            if isinstance(cols, list):
                cols = {f.name: [r[f.name] for r in cols] for f in arrow}
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def filter_texts(df: DataFrame, text_col: str, keep: Callable[[list[str]], list[bool]]) -> DataFrame:
    """Rows of ``df`` whose text passes ``keep`` (called once per batch); all columns stay as they are."""
    bounded_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep([t or "" for t in b.column(at).to_pylist()]), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def rewrite_texts(df: DataFrame, text_col: str, rewrite: Callable[[list[str]], list[str]]) -> DataFrame:
    """``df`` with its texts rewritten (null stays null); all other columns stay as they are."""
    bounded_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = iter(rewrite([t for t in old if t is not None]))
            col = pa.array([None if t is None else next(new) for t in old], type=b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], col, *b.columns[at + 1:]], schema=b.schema)

    return df.mapInArrow(run, df.schema)


def ordered_buckets(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, list[int]]:
    """Deal documents into ascending ranges of doc_id; returns them with ``bucket`` and the inner bounds.

    The bounds are approximate quantiles of all ids (one column-pruned
    aggregate; as many numbers as buckets come to the driver). Bucket ``i``
    holds the ids above ``i`` bounds; a null id goes first.
    """
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select("doc_id").agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("q")).first().q
    bounds = sorted(set(cuts or []))
    if not bounds:
        return docs.withColumn("bucket", F.lit(0)), []
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), side="left"))

    return docs.withColumn("bucket", bucket(F.coalesce("doc_id", F.lit(-(1 << 63))))), bounds
