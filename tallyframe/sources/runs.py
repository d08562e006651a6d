"""The files of evaluation runs: scores, reports and failures that appear together.

    <folder>/parts/<attempt>/scores, reports, failures
    <folder>/runs/...       JSON lines, one file per committed attempt

A run that fails half way leaves parts that nobody reads; writing it again makes
new ones. Of several commits of one run a single one counts.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyframe.operators.scoring import failures, report
from tallyframe.sources.reports import read_failures, read_reports, write_failures, write_report


@dataclass(frozen=True)
class Run:
    scores: DataFrame
    reports: DataFrame
    failures: DataFrame


def write_run(scored: DataFrame, folder: str, run: str) -> None:
    """Write the scores of a run, and its reports and failures from them: the plan
    of ``scored`` runs once."""
    spark = scored.sparkSession
    attempt = f"{run}.{uuid.uuid4().hex[:12]}"
    parts = f"{folder}/parts/{attempt}"
    scored.write.parquet(f"{parts}/scores")
    kept = spark.read.schema(scored.schema).parquet(f"{parts}/scores")
    write_report(report(kept), f"{parts}/reports")
    write_failures(failures(kept), f"{parts}/failures")
    line = spark.range(1).select(F.lit(run).alias("run"), F.lit(attempt).alias("attempt"), F.lit(scored.schema.json()).alias("schema"))
    line.coalesce(1).write.mode("append").json(f"{folder}/runs")


def list_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run, attempt, schema) of the committed runs."""
    lines = spark.read.schema("run string, attempt string, schema string").option("mode", "FAILFAST").json(f"{folder}/runs")
    return lines.groupBy("run").agg(F.min(F.struct("attempt", "schema")).alias("_a")).select("run", "_a.*")


def read_run(spark: SparkSession, folder: str, run: str) -> Run:
    """The parts of one run; a run that was not committed is an error."""
    found = list_runs(spark, folder).where(F.col("run") == run).first()
    if found is None:
        raise ValueError(f"no run {run} in {folder}")
    parts = f"{folder}/parts/{found['attempt']}"
    scores = spark.read.schema(StructType.fromJson(json.loads(found["schema"]))).parquet(f"{parts}/scores")
    return Run(scores, read_reports(spark, f"{parts}/reports", one_per_file=False), read_failures(spark, f"{parts}/failures"))
