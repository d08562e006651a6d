"""Build a labelled example set from templates: expand, split, number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.curation import expand_templates, normalize_ws
from tallyframe.operators.positions import assign_ids, stratified_split
from tallyframe.session import stored


def build_examples(
    templates: DataFrame,
    params: DataFrame,
    counts: DataFrame | None = None,
    fraction: float = 0.2,
    seed: int = 7,
) -> DataFrame:
    """(split, category, question, sql, id), and ``gold_row_count`` where
    ``counts`` (template_id, value, gold_row_count) gives it.

    Each category sends ``fraction`` of its examples to 'eval', one at least.
    Both steps read their input several times, so it is written before each.
    """
    examples = expand_templates(templates, params)
    kept = ["split", "category", "question", "sql", "id"]
    if counts is not None:
        examples = examples.withColumn("_value", F.coalesce("value", F.lit("")))
        known = counts.select(
            "template_id", F.coalesce("value", F.lit("")).alias("_value"), "gold_row_count"
        )
        examples = examples.join(known, ["template_id", "_value"], "left").drop("_value")
        kept.insert(4, "gold_row_count")
    keyed = normalize_ws(examples, "sql").withColumn(
        "_key", F.concat_ws("/", "template_id", "question")
    )
    parts = stratified_split(stored(keyed, "examples"), "category", "_key", fraction, seed)
    numbered = assign_ids(stored(parts, "split"), F.col("split"), "_key", seed + 1, ("split",))
    return numbered.select(*kept)
