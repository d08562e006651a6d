"""Tables that compare runs: leaderboard, category matrix, first failures,
result previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import dollars, fixed, percent


def leaderboard(reports: DataFrame) -> DataFrame:
    """One line of formatted text columns per report."""
    return reports.select(
        "predictor",
        percent("accuracy").alias("accuracy"),
        "n",
        fixed("latency_ms.p50").alias("p50_ms"),
        fixed("latency_ms.p95").alias("p95_ms"),
        dollars("cost_per_1k_usd", missing="n/a (no cost data)").alias("cost_per_1k"),
    )


def category_names(reports: DataFrame) -> DataFrame:
    """All categories that occur in any report."""
    names = F.explode(F.map_keys("accuracy_by_category")).alias("category")
    return reports.select(names).distinct()


def category_rows(reports: DataFrame) -> DataFrame:
    """(predictor, category, accuracy), from the map in each report."""
    return reports.select(
        "predictor", F.explode("accuracy_by_category").alias("category", "accuracy")
    )


def category_matrix(reports: DataFrame, predictors: list[str] | None = None) -> DataFrame:
    """Categories by predictors; null where a report lacks the category.
    Naming the predictors saves the job that looks them up."""
    return (
        category_rows(reports)
        .groupBy("category")
        .pivot("predictor", predictors)
        .agg(F.first("accuracy"))
    )


def first_rows(df: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group with ``place`` (from 1), ``total``
    and ``remaining``.

    Each map task keeps only its own first ``k`` rows of a group before the
    shuffle (the filter on the rank makes Spark do that); the total is a
    separate pre-aggregated count, since a window count would need all rows.
    Rows with a null ``by`` are a group of their own.
    """
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    counts = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("total"))
    return (
        ranked.where(F.col("place") <= k)
        .join(counts, F.col(by).eqNullSafe(F.col("_by")))
        .drop("_by")
        .withColumn("remaining", F.greatest(F.col("total") - k, F.lit(0)))
    )


def top_failures(failed: DataFrame, k: int = 10) -> DataFrame:
    """First failures of each predictor and how many more there are."""
    return first_rows(failed, "predictor", ["id"], k)


def preview(results: DataFrame, k: int = 6) -> DataFrame:
    """First ``k`` rows of each result as an array, with the true row count
    and whether rows are left out."""
    head = first_rows(results, "example_id", ["pos"], k)
    rows = F.sort_array(F.collect_list(F.struct("place", "cells")))
    return head.groupBy("example_id", "total").agg(rows.alias("_rows")).select(
        "example_id",
        F.transform("_rows", lambda r: r["cells"]).alias("result_rows"),
        F.col("total").alias("result_row_count"),
        (F.col("total") > k).alias("result_truncated"),
    )


def recorded_run(scored: DataFrame, predicted_rows: DataFrame, k: int = 6) -> DataFrame:
    """One row per scored answer with the first ``k`` rows of its result, the full
    count, whether rows are left out, and the error. An answer with an error, or
    without result rows, shows none.

    ``scored`` as from ``score``; ``predicted_rows``: id, predictor, pos, cells.
    """
    key = F.struct("id", "predictor").alias("example_id")
    shown = preview(predicted_rows.select(key, "pos", "cells"), k)
    told = F.col("exec_error").isNull() & F.col("result_rows").isNotNull()
    joined = scored.withColumn("example_id", F.struct("id", "predictor")).join(shown, "example_id", "left")
    return joined.select(
        "id", "predictor", "category", "question", "gold_sql", F.col("sql").alias("pred_sql"),
        F.round("latency_ms", 1).alias("latency_ms"), "correct",
        F.when(told, F.col("result_rows")).otherwise(F.array().cast("array<array<string>>")).alias("result_rows"),
        F.when(told, F.col("result_row_count")).otherwise(F.lit(0)).alias("result_row_count"),
        F.when(told, F.col("result_truncated")).otherwise(F.lit(False)).alias("result_truncated"),
        F.col("exec_error").alias("error"),
    )


def capped(df: DataFrame, cap: int, order: list[str]) -> DataFrame:
    """At most ``cap`` rows, each with the true ``row_count`` and ``truncated``."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).limit(cap).select(
        "*", total.alias("row_count"), (total > cap).alias("truncated")
    )
