"""Operators for training data. Nothing outside this folder imports it."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


# Batches to Python workers: bounded by rows and bytes, so that a task holds a few
# megabytes of text whatever the length of the texts.
_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where it lies,
    and keep the batches they get small.

    On a cluster of several machines the package is installed there, or handed
    over with --py-files, as any PySpark package is.
    """
    for key, value in _BATCH.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if context.master.startswith("local"):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark
