"""I1–I4 — Structured Streaming ingest and live time-bucket aggregates.

* I1 ``start_ingest``: a file-source stream over export folders with the
  same tag rows as the batch scan (bounded memory, parallel
  across splits); each micro-batch goes through the batch ingest plan inside
  ``foreachBatch`` and leaves its counts in the store's log.
* I2 dedupe across runs: the batch plan's first-wins + anti-join against the
  stored keys (C1), so state lives in the table, not in the stream — a
  replayed micro-batch (same ``batch_id`` after a failure) is a no-op.
  :func:`dedupe_stream` offers the in-stream alternatives (unbounded
  ``dropDuplicates`` or ``dropDuplicatesWithinWatermark``).
* I3 new-file pickup: the file source's checkpoint remembers processed files;
  ``trigger(availableNow=True)`` processes what is new and stops.
* I4 ``run_bucket_stream``: hour/day/month buckets kept up to date from the rows that each micro-batch has
  newly stored (:mod:`kardia.streaming.buckets`); late rows always count, as with recompute-on-read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from kardia.manifest import SUBJECT, Manifest
from kardia.plans.ingest import IngestReport, subject_from_path, write_tables
from kardia.plans.store import TableStore
from kardia.sources import records as rec
from kardia.sources import tags
from kardia.streaming.buckets import LiveBuckets


# files of a micro-batch, at most; bounds its work whatever has piled up
MAX_FILES_PER_TRIGGER = 1000


def record_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = MAX_FILES_PER_TRIGGER,
                  subject: Column | None = None) -> DataFrame:
    """Streaming record chunks of every export file in ``folder``.

    ``subject`` is an expression over ``file_path`` and ``chunk``; by default the file's folder."""
    chunks = rec.record_chunks(tags.tag_stream(spark, folder, max_files_per_trigger))
    return chunks.withColumn(SUBJECT, subject if subject is not None else subject_from_path(F.col("file_path"))).select("chunk", SUBJECT)


def ingest_batch(spark: SparkSession, rows: DataFrame, batch_id: str, store: TableStore,
                 manifest: Manifest, staging_root: str, subject: Column | None = None,
                 on_new: dict[str, Callable[[DataFrame, str], None]] | None = None) -> IngestReport:
    """One micro-batch of tag rows through the batch plan — records, workouts and daily summaries; idempotent under replay."""
    report = IngestReport()
    write_tables(spark, rows, subject, store, manifest, report, batch_id, staging=f"{staging_root}/{batch_id}", on_new=on_new)
    return report


def batch_name(checkpoint: str, batch_id: int) -> str:
    """The name of a micro-batch in the store's log: a replay after a failure has the same."""
    return f"stream-{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}-{batch_id}"


def start_ingest(spark: SparkSession, folder: str, store: TableStore, manifest: Manifest,
                 checkpoint: str, available_now: bool = True, processing_time: str | None = None,
                 max_files_per_trigger: int = MAX_FILES_PER_TRIGGER, subject: Column | None = None,
                 on_new: dict[str, Callable[[DataFrame, str], None]] | None = None) -> StreamingQuery:
    """Continuous (or available-now) ingest of new export files.

    Every record and element tells its own subject, as in :func:`kardia.plans.ingest.ingest_export`; the counts of
    each micro-batch are in the store's log."""
    rows = tags.tag_stream(spark, folder, max_files_per_trigger)

    def run(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch.sparkSession, batch, batch_name(checkpoint, batch_id), store, manifest, f"{checkpoint}/staging", subject, on_new)

    w = rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{checkpoint}/source")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def dedupe_stream(df: DataFrame, key_cols: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """In-stream dedupe: without a watermark the state grows for ever (T8);
    with ``(event_time_col, delay)`` duplicates are dropped within the delay."""
    if watermark is None:
        return df.dropDuplicates(key_cols)
    col, delay = watermark
    return df.withWatermark(col, delay).dropDuplicatesWithinWatermark(key_cols)


def run_bucket_stream(spark: SparkSession, folder: str, manifest: Manifest, table: str, bucket: str,
                      aggs: dict[str, str], out_path: str, checkpoint: str, subject: Column | None = None,
                      subject_cols: list[str] | tuple[str, ...] = ()) -> LiveBuckets:
    """I4 to completion: the export files of ``folder`` that are new go to the checkpoint's store, and the rows
    that are new there into the buckets at ``out_path``."""
    live = LiveBuckets(spark, out_path, bucket, aggs, subject_cols)
    store = TableStore(spark, f"{checkpoint}/store", manifest)
    start_ingest(spark, folder, store, manifest, checkpoint, subject=subject, on_new={table: live.merge}).awaitTermination()
    return live
