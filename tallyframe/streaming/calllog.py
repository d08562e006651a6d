"""Append calls to the log as they arrive.

The log grows call by call; as a stream this is one incremental append. The
checkpoint records which input files are done, and each batch is committed to the
log under its number, so a batch that is repeated after a restart counts once.
Readers see what batch jobs append to the same log as well.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyframe.sources.calllog import CALL_SCHEMA, append_calls, as_calls

_BROKEN = "_broken"


def stream_calls(spark: SparkSession, folder: str, broken: bool = False) -> DataFrame:
    """Call records that arrive as JSON line files in ``folder``. A line that is no
    call record stops the stream; with ``broken`` it is kept as text in a column of
    its own, for ``append_stream`` to set aside."""
    if not broken:
        return spark.readStream.schema(CALL_SCHEMA).option("mode", "FAILFAST").json(folder)
    lines = spark.readStream.schema(f"{CALL_SCHEMA}, {_BROKEN} string").option("columnNameOfCorruptRecord", _BROKEN)
    return lines.json(folder).withColumn("_file", F.col("_metadata.file_path"))


def append_stream(
    calls: DataFrame, log: str, checkpoint: str, once: bool = True, most_broken: int = 100
) -> StreamingQuery:
    """Start the append. ``once`` takes all that is there and stops.

    The checkpoint's path names the stream's batches, so streams that write to
    one log need a checkpoint each, given alike at every start.

    Broken lines, where ``calls`` keeps them, go to ``<log>/broken`` with their
    file (see ``read_broken``). More than ``most_broken`` in one batch stop the
    stream before anything of the batch is written.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        token = f"{stream}-{number}"
        if _BROKEN in batch.columns:
            batch = batch.persist()  # both halves come from one read, as Spark asks of a broken-line column
            bad = batch.where(F.col(_BROKEN).isNotNull()).select(F.col("_file").alias("file"), F.col(_BROKEN).alias("line"))
            n = bad.limit(most_broken + 1).count()
            if n > most_broken:
                raise ValueError(f"more than {most_broken} broken lines in batch {number}")
            if n:
                bad.write.mode("overwrite").json(f"{log}/broken/batch={token}")
            append_calls(batch.where(F.col(_BROKEN).isNull()), log, token)
            batch.unpersist()
        else:
            append_calls(batch, log, token)

    # Ids and times are filled in before the batch: its time is kept in the checkpoint.
    extra = [c for c in (_BROKEN, "_file") if c in calls.columns]
    writer = as_calls(calls, *extra).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_broken(spark: SparkSession, log: str) -> DataFrame:
    """(file, line, batch) of the lines that were set aside."""
    return spark.read.schema("file string, line string, batch string").json(f"{log}/broken")
