"""The call log: parquet folders, and a list of commits that says which count.

    <log>/calls/batch=<folder>/day=<day>/...   rows of one append
    <log>/commits/...                          JSON lines, one file per commit

An append writes its rows into a folder of its own and then commits it; a reader
opens the committed folders only. A job that fails, or is run again, leaves rows
that nobody sees. Appends carry a token: of several commits with one token a
single one counts, so an append can be repeated until it succeeds, and a batch
that a stream repeats after a restart counts once.

A commit holds a line for each predictor with the sums that statistics need, so
they come from the commits, without reading the calls. Compaction writes the rows
of many small folders into one and commits it with the list of folders that it
replaces: readers see either those or the new one. Replaced folders stay for the
readers that have opened them (``unused_folders`` lists them). One compaction
runs at a time.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALL_SCHEMA = (
    "id string, ts timestamp_ntz, source string, predictor string, question string, "
    "sql string, latency_ms double, input_tokens bigint, output_tokens bigint, "
    "cost_usd double, error string"
)
_OPTIONAL = {
    "sql": "string", "latency_ms": "double", "input_tokens": "bigint",
    "output_tokens": "bigint", "cost_usd": "double", "error": "string",
}
COMMIT_SCHEMA = (
    "token string, folder string, replaces array<string>, predictor string, n_calls bigint, "
    "n_timed bigint, latency_ms double, n_succeeded bigint, cost_usd double"
)
SMALL_ROWS = 1_000_000
_FIELDS = [f.split()[0] for f in CALL_SCHEMA.split(", ")]


def _dated(df: DataFrame) -> DataFrame:
    if "ts" not in df.columns:
        now = F.date_trunc("second", F.current_timestamp()).cast("timestamp_ntz")
        df = df.withColumn("ts", now)
    return df.withColumn("day", F.to_date("ts"))


def as_calls(df: DataFrame, *more: str) -> DataFrame:
    """Fill in what a call may leave out: id, time, optional fields. Other columns
    go, but for ``more``."""
    df = _dated(df)
    if "id" not in df.columns:
        df = df.withColumn("id", F.expr("uuid()"))
    for name, dtype in _OPTIONAL.items():
        if name not in df.columns:
            default = F.lit(0.0) if name == "latency_ms" else F.lit(None)
            df = df.withColumn(name, default.cast(dtype))
    return df.select(*_FIELDS, "day", *more)


def call_sums(calls: DataFrame) -> DataFrame:
    """What statistics need of some calls, a row per predictor; sums of sums are
    the sums of all."""
    return calls.groupBy("predictor").agg(
        F.count("*").alias("n_calls"), F.count("latency_ms").alias("n_timed"), F.sum("latency_ms").alias("latency_ms"),
        F.count_if(F.col("error").isNull()).alias("n_succeeded"), F.sum("cost_usd").alias("cost_usd"),
    )


def _open(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    schema = f"{CALL_SCHEMA}, day date, batch string"
    if not folders:
        return spark.createDataFrame([], schema).drop("batch")
    paths = [f"{path}/calls/batch={f}" for f in folders]
    return spark.read.schema(schema).option("basePath", f"{path}/calls").parquet(*paths).drop("batch")


def _commits(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(COMMIT_SCHEMA).option("mode", "FAILFAST").json(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT_SCHEMA)


def _write(rows: DataFrame, path: str, token: str) -> str:
    """Rows into a folder that nothing else writes to, gathered by day, a large
    day split again by size: few files, however many tasks ran."""
    folder = f"{token}.{uuid.uuid4().hex[:12]}"
    rows.withColumn("batch", F.lit(folder)).write.mode("append").partitionBy("batch", "day").parquet(f"{path}/calls")
    return folder


def _commit(spark: SparkSession, path: str, token: str, folder: str, replaces: list[str]) -> None:
    """Make a folder count, by one file that appears whole or not at all."""
    replaced = F.array(*[F.lit(f) for f in replaces]).cast("array<string>")
    lines = call_sums(_open(spark, path, [folder])).select(F.lit(token).alias("token"), F.lit(folder).alias("folder"), replaced.alias("replaces"), "*")
    lines.coalesce(1).write.mode("append").json(f"{path}/commits")


def live_sums(spark: SparkSession, path: str) -> DataFrame:
    """The commit lines that count: of each token those of one folder, without the
    folders that others replace."""
    commits = _commits(spark, path)
    counted = commits.groupBy(F.col("token").alias("_t")).agg(F.min("folder").alias("_folder"))
    gone = commits.select(F.explode("replaces").alias("folder"))
    return commits.join(counted, (F.col("token") == F.col("_t")) & (F.col("folder") == F.col("_folder"))).drop("_t", "_folder").join(
        gone, "folder", "left_anti")


def append_calls(df: DataFrame, path: str, token: str | None = None) -> bool:
    """Append calls; False if an append with this token has been committed before,
    which leaves the log as it is. Without a token every append counts. Ids are
    drawn after the shuffle by day, so a repeated map task changes nothing. An
    append without rows leaves no trace."""
    spark = df.sparkSession
    if token is not None and _commits(spark, path).where(F.col("token") == token).limit(1).count():
        return False
    token = token or f"append-{uuid.uuid4().hex}"
    rows = as_calls(_dated(df).hint("rebalance", "day"))
    folder = _write(rows, path, token)
    try:
        _commit(spark, path, token, folder, [])
    except AnalysisException as error:  # nothing was written
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return True


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """The calls of all committed appends. The list of live folders, one name per
    append since the last compaction, goes through the driver; filters on ``day``
    leave out the other days' folders."""
    folders = [r["folder"] for r in live_sums(spark, path).select("folder").distinct().collect()]
    return _open(spark, path, sorted(folders))


def compact_calls(spark: SparkSession, path: str, small_rows: int = SMALL_ROWS) -> list[str]:
    """Put the folders of fewer than ``small_rows`` calls into one and return
    their names; nothing is done for a single one."""
    sizes = live_sums(spark, path).groupBy("folder").agg(F.sum("n_calls").alias("n")).where(F.col("n") < small_rows)
    small = sorted(r["folder"] for r in sizes.select("folder").collect())
    if len(small) < 2:
        return []
    token = "compact-" + hashlib.sha256("\n".join(small).encode()).hexdigest()[:16]
    folder = _write(_open(spark, path, small).hint("rebalance", "day"), path, token)
    _commit(spark, path, token, folder, small)
    return small


def unused_folders(spark: SparkSession, path: str) -> DataFrame:
    """Committed folders that no new reader opens: replaced ones, and later
    commits of a token."""
    live = live_sums(spark, path).select("folder").distinct()
    return _commits(spark, path).select("folder").distinct().join(live, "folder", "left_anti")
