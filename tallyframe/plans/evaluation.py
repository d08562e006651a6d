"""A whole evaluation run: predictions and result rows in, scored rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.comparison import flag_ordered, match_predictors
from tallyframe.operators.fingerprints import chosen, fingerprints
from tallyframe.operators.scoring import judged, known_examples


def _settled(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key: of several, the one with the greatest values, compared
    column by column as they stand (a null is least)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def every_answer(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """One prediction for each row of ``examples`` and each predictor, and those
    of unknown ids.

    An example that a predictor left out gets a row with the error "no
    prediction". The list of predictors has one entry per model.
    """
    names = predictions.agg(F.collect_set("predictor")).scalar()
    due = examples.withColumn("predictor", F.explode(names))
    made = _settled(predictions, "id", "predictor").withColumn("_made", F.lit(True))
    missing = F.when(F.col("_made").isNull(), F.lit("no prediction")).otherwise(F.col("error"))
    return due.join(made, ["id", "predictor"], "full").withColumn("error", missing).drop("_made")


def evaluate(
    examples: DataFrame,
    predictions: DataFrame,
    gold_rows: DataFrame,
    predicted_rows: DataFrame,
    exact: bool = False,
) -> DataFrame:
    """Score every example for every predictor, once, in one plan.

    ``examples``: id, question, category, sql. ``predictions``: id, predictor,
    sql, latency_ms, cost_usd, error, run_error. ``gold_rows``: id, pos, cells,
    once per example. ``predicted_rows``: predictor, id, pos, cells. Of rows that
    repeat an id (and predictor), the one with the greatest values counts.

    Results are reduced to fingerprints where they lie: one row per example, or
    example and predictor, and map task is shuffled, never the cells. With
    ``exact`` the rows themselves are compared.
    """
    examples = _settled(examples, "id")
    known = known_examples(flag_ordered(examples), "ordered")
    if exact:
        answers = every_answer(known.drop("ordered"), predictions)
        verdicts = match_predictors(known.select("id", "ordered"), answers.select("id", "predictor"), gold_rows, predicted_rows)
        return judged(answers.join(verdicts, ["id", "predictor"], "left"))
    gold = fingerprints(gold_rows, "id")
    wanted = known.join(gold, "id", "left").select(*known.columns, chosen("ordered").alias("_wanted"))
    shown = fingerprints(predicted_rows, "id", "predictor")
    answers = every_answer(wanted, predictions).join(shown, ["id", "predictor"], "left")
    matched = F.col("_wanted") == chosen("ordered")
    return judged(answers.withColumn("matched", matched).drop("_wanted", "as_set", "as_list", "ordered"))
