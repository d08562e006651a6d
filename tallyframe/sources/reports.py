"""Run reports: nested JSON, one object per predictor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAILURE_FIELDS = (
    "id string, question string, category string, gold_sql string, pred_sql string, "
    "exec_error string"
)
REPORT_SCHEMA = (
    "predictor string, accuracy double, n bigint, accuracy_by_category map<string,double>, "
    "latency_ms struct<p50:double, p95:double, mean:double>, total_cost_usd double, "
    "cost_per_1k_usd double, failures array<struct<id:string, question:string, "
    "category:string, gold_sql:string, pred_sql:string, exec_error:string>>"
)


def read_reports(spark: SparkSession, paths: str | list[str], one_per_file: bool = True) -> DataFrame:
    """Nested reports. ``one_per_file`` reads files that hold one (indented)
    object each; otherwise each line is a report. Malformed content is an error."""
    read = spark.read.schema(REPORT_SCHEMA).option("multiLine", one_per_file)
    return read.option("mode", "FAILFAST").json(paths)


def report_failures(reports: DataFrame) -> DataFrame:
    """The failure list of each report as rows."""
    return reports.select("predictor", F.explode("failures").alias("_f")).select("predictor", "_f.*")


def write_report(report: DataFrame, path: str, one_per_file: bool = False) -> None:
    """One report per line; structs and maps stay nested. ``one_per_file`` writes
    each as an indented object in a file of its own."""
    out = report.write.mode("overwrite").option("ignoreNullFields", "false")
    if one_per_file:
        out = out.option("maxRecordsPerFile", 1).option("pretty", "true")
    out.json(path)


def write_failures(failed: DataFrame, path: str) -> None:
    """Failures next to the reports: a folder per predictor, one failure per
    line. Rows are gathered by predictor and a large predictor is split again,
    so many tasks write it and few files come out."""
    failed.hint("rebalance", "predictor").write.mode("overwrite").partitionBy("predictor").json(path)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failures as written by ``write_failures``. Malformed content is an error."""
    return spark.read.schema(f"{FAILURE_FIELDS}, predictor string").option("mode", "FAILFAST").json(path)
