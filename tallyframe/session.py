"""Session settings and the shared scratch folder.

``tune`` only touches runtime SQL settings, so it is safe on a session that
somebody else built. ``shared_dir`` is the single place that decides where
intermediate tables are written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split at run time, also where a later operator then
    # needs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


_FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


# What a shuffle partition may hold on average before small ones are merged.
PARTITION_BYTES = 128 << 20


def tune(spark: SparkSession, shuffled_bytes: int | None = None) -> SparkSession:
    """Turn on run-time re-planning, skew splitting included.

    Where the cluster has more cores than shuffle partitions, shuffles start
    with three partitions per core; small ones are merged again at run time.
    ``shuffled_bytes`` is the size of the largest shuffle to come, where it is
    known: shuffles then start with a partition for each ``PARTITION_BYTES`` of it
    if those are more, so that a partition fits in memory at any size.
    """
    for key, value in _ADAPTIVE.items():
        spark.conf.set(key, value)
    cores = spark.sparkContext.defaultParallelism
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = int(spark.conf.get(_FIRST_PARTITIONS, None) or 0)
    wanted = 3 * cores if cores > partitions and not known else 0
    if shuffled_bytes is not None:
        wanted = max(wanted, -(-shuffled_bytes // PARTITION_BYTES))
    if wanted > max(known, partitions if shuffled_bytes is not None else 0):
        spark.conf.set(_FIRST_PARTITIONS, str(wanted))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, visible to every executor.

    Only a local session without that setting gets a temporary folder; on a
    cluster such a folder would live on one machine, so that case is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tallyframe-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For a result that several later branches read: they then scan parquet
    instead of repeating the work, and a lost executor costs a re-read only.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
