"""Labelled examples as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EXAMPLE_SCHEMA = (
    "question string, sql string, category string, gold_row_count bigint, id string"
)


def read_examples(spark: SparkSession, path: str | list[str], schema: str = EXAMPLE_SCHEMA) -> DataFrame:
    """Examples; a malformed line or a value of another type is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_examples(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; null fields are kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
