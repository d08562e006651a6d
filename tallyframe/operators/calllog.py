"""Statistics of the call log, from the calls or from sums of parts of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.values import rounded_or_null, rounded_or_zero

EVERYONE = "all"


def _measures() -> list[Column]:
    succeeded = F.count_if(F.col("error").isNull())
    return _shown(F.count("*"), F.avg("latency_ms"), succeeded, F.sum("cost_usd"))


def _merged() -> list[Column]:
    """The same from the rows of ``sources.calllog.call_sums``."""
    n = F.coalesce(F.sum("n_calls"), F.lit(0))
    mean = F.sum("latency_ms") / F.nullif(F.sum("n_timed"), F.lit(0))
    return _shown(n, mean, F.sum("n_succeeded"), F.sum("cost_usd"))


def _shown(n: Column, mean: Column, succeeded: Column, cost: Column) -> list[Column]:
    return [
        n.alias("n_calls"),
        rounded_or_null(mean, 1).alias("avg_latency_ms"),
        F.round(succeeded / F.nullif(n, F.lit(0)), 3).alias("success_rate"),
        rounded_or_zero(cost, 6).alias("total_cost_usd"),
    ]


def stats(calls: DataFrame, predictor: str | None = None, sums: bool = False) -> DataFrame:
    """One row for one predictor, or for all of them if none (or '') is named.
    With ``sums`` the rows are sums of calls instead of calls."""
    chosen = calls.where(F.col("predictor") == predictor) if predictor else calls
    measures = _merged() if sums else _measures()
    return chosen.agg(*measures).select(F.lit(predictor or EVERYONE).alias("predictor"), "*")


def stats_by_predictor(calls: DataFrame, sums: bool = False) -> DataFrame:
    """Every predictor and the total line, in one pass."""
    label = F.when(F.grouping("predictor") == 1, F.lit(EVERYONE)).otherwise(F.col("predictor"))
    return (
        calls.rollup("predictor")
        .agg(label.alias("_label"), *(_merged() if sums else _measures()))
        .select(F.col("_label").alias("predictor"), "n_calls", "avg_latency_ms",
                "success_rate", "total_cost_usd")
    )
