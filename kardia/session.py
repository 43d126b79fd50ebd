"""Session construction and the shared scratch location.

Cluster jobs read ``spark.checkpoint.dir`` (a shared, fault-tolerant folder
named by the cluster). Only when it is unset — local tests — do we set our
own under the system temp folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Session settings every kardia job relies on.
_BASE_CONF = {
    # All timestamps are handled as UTC instants (manifest `timezone = "UTC"`).
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesce small shuffles, split skewed join
    # partitions, convert to broadcast only once real sizes are known.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app_name: str = "kardia",
                  shuffle_partitions: int | None = None,
                  extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Create (or fetch) a session with kardia's required settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable part of the configuration to an existing session."""
    for k, v in _BASE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    # Listing many files/folders runs a Spark job with one task per path by
    # default (up to 10,000); a few tasks per core list them just as fast.
    par = max(8, 2 * spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(par))
    return spark


def scratch_dir(spark: SparkSession, purpose: str = "run") -> str:
    """A fresh sub-folder of the cluster's checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Only a local master without
    it (tests) gets a folder under the system temp dir; on a cluster a missing
    setting is an error, because executors would write where nobody else reads.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="kardia-ckpt-")
        sc.setCheckpointDir(base)
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex[:12]}")


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query are deleted as it ends. By default they stay until the driver
    collects its plan, so the steps of a job that writes one table after the other would add up on disk."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
