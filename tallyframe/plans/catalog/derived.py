"""Call, prediction and scoring tables derived from the star-schema tables, as
DataFrames and as SQL.

``events`` plays the log of a predictor service: the event type is the
predictor, the value its latency, and ``k`` in the properties its token count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.hashing import unit_hash
from tallyframe.plans.catalog.registry import sql_unit

PREDICTORS = ["click", "error", "purchase", "signup", "view"]


def _tokens():
    return F.get_json_object("props", "$.k").cast("bigint")


def calls(t) -> DataFrame:
    """The call log without its own id column."""
    events = t["events"].withColumn("input_tokens", _tokens())
    return events.select(
        "event_id",
        "ts",
        F.when(F.col("input_tokens") % 2 == 0, "batch").otherwise("tool").alias("source"),
        F.col("event_type").alias("predictor"),
        F.concat(F.lit("question of user "), F.col("user_id").cast("string")).alias("question"),
        F.concat(F.lit("SELECT "), F.col("input_tokens").cast("string")).alias("sql"),
        F.col("value").alias("latency_ms"),
        "input_tokens",
        (F.col("input_tokens") * 3).alias("output_tokens"),
        F.when(F.col("user_id") % 7 != 0, F.col("input_tokens") / 1e6 * 2.5).alias("cost_usd"),
        F.when(F.col("user_id") % 11 == 0, F.lit("timeout")).alias("error"),
    )


SQL_CALLS = """calls AS (
    SELECT event_id, ts, CASE WHEN k % 2 = 0 THEN 'batch' ELSE 'tool' END AS source,
           event_type AS predictor, 'question of user ' || user_id AS question,
           'SELECT ' || k AS sql, value AS latency_ms, k AS input_tokens, k * 3 AS output_tokens,
           CASE WHEN user_id % 7 <> 0 THEN k / 1e6 * 2.5 END AS cost_usd,
           CASE WHEN user_id % 11 = 0 THEN 'timeout' END AS error
    FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM events))"""


def scored(t) -> DataFrame:
    """One scored prediction per event."""
    failed = F.col("user_id") % 11 == 0
    return t["events"].select(
        F.format_string("call-%06d", "event_id").alias("id"),
        F.col("event_type").alias("predictor"),
        F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string")).alias("category"),
        F.concat(F.lit("question "), F.col("event_id").cast("string")).alias("question"),
        F.lit("SELECT 1").alias("gold_sql"),
        F.lit("SELECT 2").alias("sql"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("user_id") % 7 != 0, _tokens() / 1e6 * 2.5).alias("cost_usd"),
        F.when(failed, F.lit("execution error: no such column: x")).alias("exec_error"),
        (~failed & (unit_hash(3, "event_id") < 0.7)).alias("correct"),
    )


SQL_SCORED = f"""scored AS (
    SELECT printf('call-%06d', event_id) AS id, event_type AS predictor,
           'c' || (user_id % 10) AS category, 'question ' || event_id AS question,
           'SELECT 1' AS gold_sql, 'SELECT 2' AS sql, value AS latency_ms,
           CASE WHEN user_id % 7 <> 0
                THEN cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) / 1e6 * 2.5 END AS cost_usd,
           CASE WHEN user_id % 11 = 0 THEN 'execution error: no such column: x' END AS exec_error,
           user_id % 11 <> 0 AND {sql_unit(3, 'event_id')} < 0.7 AS correct
    FROM events)"""


def rounded(df: DataFrame, places: int = 6, only: list[str] | None = None) -> DataFrame:
    """Round the real columns: sums of reals depend on the order of the rows."""
    return df.select(
        *[
            F.round(f.name, places).alias(f.name)
            if f.dataType.typeName() == "double" and (only is None or f.name in only)
            else f.name
            for f in df.schema.fields
        ]
    )
