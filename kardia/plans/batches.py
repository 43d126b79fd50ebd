"""C2, C3 — the commit log of a store: one record per batch, written after all its tables.

``begin`` leaves a mark before a batch's first append, ``commit`` renames the finished record into place. A batch
that is in the log is skipped when it is replayed; one that has only begun is completed: its rows carry its id, so
those appended before the failure are found, not added again, and counted. Readers can ask for
committed rows (:meth:`kardia.plans.store.TableStore.read`) and read the log as a table.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

LOG_SCHEMA = "batch string, table_name string, mapped long, inserted long, quarantined long, files long"


def file_system(spark: SparkSession, path: str):
    """(Hadoop FileSystem, Path) of a path of any scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Recursively delete a folder this job created."""
    fs, p = file_system(spark, path)
    return fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole: written aside, then renamed into place."""
    fs, p = file_system(spark, path)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.getParent(), f"._{p.getName()}")
    out = fs.create(aside, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    fs.delete(p, False)
    if not fs.rename(aside, p):
        raise OSError(f"cannot rename {aside} to {p}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(int(fs.getFileStatus(p).getLen()))).decode("utf-8")
    finally:
        stream.close()


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root}/_log"

    def _path(self, batch: str, kind: str) -> str:
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"batch id {batch!r} is not a plain name")
        return f"{self.root}/{kind}/{batch}"

    def committed(self, batch: str) -> bool:
        return path_exists(self.spark, self._path(batch, "committed"))

    def begin(self, batch: str) -> bool:
        """Mark the batch as begun; True if it had begun before (an attempt failed)."""
        path = self._path(batch, "begun")
        if path_exists(self.spark, path):
            return True
        write_text(self.spark, path, "")
        return False

    def commit(self, batch: str, rows: list[dict]) -> None:
        """Rows: ``table_name, mapped, inserted, quarantined, files``; as many as the manifest has tables."""
        write_text(self.spark, self._path(batch, "committed"), "\n".join(json.dumps({"batch": batch, **r}) for r in rows))

    def entry(self, batch: str) -> list[dict]:
        return [json.loads(line) for line in read_text(self.spark, self._path(batch, "committed")).splitlines()]

    def read(self) -> DataFrame:
        """A row per committed batch and table."""
        if not path_exists(self.spark, f"{self.root}/committed"):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).json(f"{self.root}/committed")
