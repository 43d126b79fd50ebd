"""Parquet table store: one folder per manifest table under a root path.

Stored tables are **bucketed by their key**: ``_key`` is 128 bits of a hash of subject and key, and a table's files are dealt
into a fixed number of buckets by it. A row is only appended if its key is not stored yet (C1), so a
retried or replayed batch is a no-op (D8); that anti-join deals only the batch, the stored side is read bucket by
bucket, without an exchange. Rows are sorted by ``start_date`` within each bucket file, so Parquet statistics prune time ranges,
of appends and of queries. Each row carries the id of its batch (``_batch``), see :mod:`kardia.plans.batches`.

Reads conform old files to the current manifest schema: columns added since
are NULL (B13) and generated ``expression`` columns are computed (B11).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from kardia.manifest import SUBJECT, Manifest, ecg_schema, route_schema, table_schema
from kardia.operators.dedupe import dedupe_first_wins
from kardia.operators.routing import conform, with_generated_columns
from kardia.plans.batches import CommitLog, file_system, path_exists, read_text, write_text

# Buckets of a new store's tables. They bound the tasks of an append and the size of a bucket's file: choose about one per
# core of the appending cluster. Fixed for a store's lifetime.
BUCKETS = 16
KEY, BATCH = "_key", "_batch"


def row_key(columns: list[str], never_null: list[str]) -> Column:
    """128 bits of a hash of the columns, length by length, so that no two keys run together; NULL in columns of ``never_null`` is a
    value, NULL in others makes the key NULL."""
    parts = []
    for c in columns:
        part = F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c))
        parts.append(F.coalesce(part, F.lit("-")) if c in never_null else part)
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


class TableStore:
    def __init__(self, spark: SparkSession, root: str, manifest: Manifest, buckets: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.manifest = manifest
        self.log = CommitLog(spark, self.root)
        self._wanted_buckets = buckets or BUCKETS
        self._buckets: int | None = None

    # ---- layout ----------------------------------------------------------
    @property
    def buckets(self) -> int:
        """The number that the store was made with; the first append fixes it."""
        if self._buckets is None:
            path = f"{self.root}/_layout/buckets"
            if not path_exists(self.spark, path):
                write_text(self.spark, path, str(self._wanted_buckets))
            self._buckets = int(read_text(self.spark, path))
        return self._buckets

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def schema(self, table: str):
        m = self.manifest
        if table in m.tables:
            return table_schema(m.tables[table])
        if m.ecg and table == m.ecg.target_table:
            return ecg_schema(m.ecg)
        if m.routes and table == m.routes.target_table:
            return route_schema(m.routes)
        raise KeyError(table)

    def key_cols(self, table: str) -> list[str]:
        """A metric row's key, a side-car file's name; both of a subject."""
        m = self.manifest
        return [SUBJECT, m.tables[table].key if table in m.tables else "file_name"]

    def exists(self, table: str) -> bool:
        return path_exists(self.spark, self.path(table))

    def _stored_schema(self, table: str) -> StructType:
        return StructType([*self.schema(table).fields, StructField(KEY, BinaryType()), StructField(BATCH, StringType())])

    def _table(self, table: str) -> str:
        """The session catalog's name for a stored table: its folder, schema and buckets, and no data of its own."""
        schema = self._stored_schema(table)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        order = " SORTED BY (start_date)" if "start_date" in schema.names else ""
        name = "kardia_" + hashlib.sha256(f"{self.path(table)}|{ddl}|{self.buckets}".encode()).hexdigest()[:24]
        fs, p = file_system(self.spark, self.path(table))
        fs.mkdirs(p)
        location = self.path(table).replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet CLUSTERED BY ({KEY}){order} INTO {self.buckets} BUCKETS LOCATION '{location}'")
        self.spark.catalog.refreshTable(name)
        return name

    # ---- read --------------------------------------------------------------
    def read_raw(self, table: str) -> DataFrame | None:
        """Stored rows with ``_key`` and ``_batch`` under the current manifest schema: a column added
        since a file was written reads as NULL there (B13), without the extra
        job a ``mergeSchema`` footer merge would launch."""
        if not self.exists(table):
            return None
        return self.spark.read.table(self._table(table))

    def read(self, table: str, committed: bool = False) -> DataFrame:
        """Stored rows under the current manifest schema (empty if none); with ``committed``, only those of batches in the log."""
        self.manifest.check_table(table, allow_external=True)
        schema = self.schema(table)
        raw = self.read_raw(table)
        if raw is not None and committed:
            raw = raw.join(self.log.read().select(F.col("batch").alias(BATCH)).distinct(), BATCH, "left_semi")
        df = conform(raw, schema) if raw is not None else self.spark.createDataFrame([], schema)
        if table in self.manifest.tables:
            df = with_generated_columns(df, self.manifest.tables[table])
        return df

    # ---- write -------------------------------------------------------------
    def _write(self, table: str, df: DataFrame, batch: str | None) -> int:
        """Append rows dealt by their key; returns the number of rows written (observed during the write)."""
        obs = Observation(f"written_{table}")
        rows = conform(df.select("*", F.lit(batch).cast("string").alias(BATCH)), self._stored_schema(table))
        rows.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("append").insertInto(self._table(table))
        return int(obs.get.get("n", 0))

    def _of_batch(self, existing: DataFrame | None, batch: str | None, replay: bool) -> int:
        return existing.filter(F.col(BATCH) == batch).count() if replay and existing is not None else 0

    def new_rows(self, table: str, batch: DataFrame, order_cols: list[str] | None = None, time_bounds: tuple | None = None) -> tuple[DataFrame, DataFrame | None]:
        """In-batch first-wins + anti-join on stored keys: (rows to append with ``_key``, dealt by it; the stored rows met).

        ``time_bounds`` = the batch's (min, max) ``start_date``. A stored row
        can only share a key with a batch row if it has the same start
        (content ids hash the start; workout / summary keys are their start),
        so only stored rows in that range — or without a start — are read for
        the anti-join; files are sorted by ``start_date``, so the range prunes row groups."""
        keys = self.key_cols(table)
        keyed = batch.withColumn(KEY, row_key(keys, [SUBJECT]))
        rows = dedupe_first_wins(keyed, [KEY], order_cols).repartition(self.buckets, KEY)
        existing = self.read_raw(table)
        if existing is None:
            return rows, None
        if time_bounds is not None and None not in time_bounds:
            lo, hi = time_bounds
            t = F.col("start_date")
            # a day of slack: the bounds come back to Python as local wall time
            lo_c = F.timestamp_add("DAY", F.lit(-1), F.lit(lo).cast("timestamp"))
            hi_c = F.timestamp_add("DAY", F.lit(1), F.lit(hi).cast("timestamp"))
            existing = existing.filter(t.isNull() | ((t >= lo_c) & (t <= hi_c)))
        return self._absent(rows, existing.select(KEY)), existing

    def _absent(self, rows: DataFrame, stored: DataFrame) -> DataFrame:
        """Rows, dealt by key, whose key isn't among the stored ones (each there once). An outer join and not an anti-join, because the
        optimizer would push that below the dealing, and the stored side would be dealt anew."""
        seen = stored.select(F.col(KEY), F.lit(True).alias("_seen"))
        return rows.join(seen, KEY, "left").filter(F.col("_seen").isNull()).select(*rows.columns)

    def append_new(self, table: str, batch: DataFrame, order_cols: list[str] | None = None, time_bounds: tuple | None = None,
                   batch_id: str | None = None, replay: bool = False, keep: str | None = None) -> int:
        """Append the rows whose keys aren't stored; returns their number. When a failed batch is replayed, its rows that are stored already count, too.

        ``keep`` is a folder that gets the new rows first, for those who need them again (:meth:`rows_of_batch`)."""
        rows, existing = self.new_rows(table, batch, order_cols, time_bounds)
        before = self._of_batch(existing, batch_id, replay)
        if keep is not None and not replay:
            rows.write.mode("overwrite").parquet(keep)
            rows = self.spark.read.schema(rows.schema).parquet(keep).repartition(self.buckets, KEY)
        return before + self._write(table, rows, batch_id)

    def rows_of_batch(self, table: str, batch_id: str, replay: bool, keep: str) -> DataFrame:
        """The rows that a batch has added: as kept, or, when it is replayed after a failure, by their mark in the table."""
        schema = self.schema(table)
        return conform(self.read_raw(table).filter(F.col(BATCH) == batch_id) if replay else self.spark.read.parquet(keep), schema)

    def append_files(self, table: str, batch: DataFrame, batch_id: str | None = None, replay: bool = False) -> int:
        """Rows of files not stored yet (A7), each file as a unit: its rows share a key, so they lie in one bucket, written by one task."""
        existing = self.read_raw(table)
        rows = batch.withColumn(KEY, row_key(self.key_cols(table), [SUBJECT])).repartition(self.buckets, KEY)
        if existing is not None:
            rows = self._absent(rows, existing.select(KEY).distinct())
        before = self._of_batch(existing, batch_id, replay)
        return before + self._write(table, rows, batch_id)

    def counts(self) -> DataFrame:
        """F7 over every manifest and external table (a missing table counts 0)."""
        from kardia.operators.query import table_counts
        names = list(self.manifest.tables) + self.manifest.external_tables()
        return table_counts({n: self.read(n) for n in names})
