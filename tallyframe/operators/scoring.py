"""Screen statements, clean model output, score predictions, sum up a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import (
    has_write_word,
    quoted,
    starts_as_read,
    without_fence,
)
from tallyframe.operators.ordinals import high_index, keyed, read_once, select_at, upper_median


def refusal(col: str) -> Column:
    """Why a statement may not run; null if it may."""
    sql = F.col(col)
    not_a_read = F.concat(
        F.lit("SQL must start with SELECT or WITH, got: "), quoted(F.substring(sql, 1, 60))
    )
    writes = F.concat(
        F.lit("SQL contains a forbidden write/DDL keyword: "), quoted(F.substring(sql, 1, 120))
    )
    return (
        F.when(sql.isNull(), F.lit("there is no statement"))
        .when(~starts_as_read(col), not_a_read)
        .when(has_write_word(col), writes)
    )


def screen_statements(df: DataFrame, col: str) -> DataFrame:
    """Add ``allowed`` and ``reason``."""
    screened = df.withColumn("reason", refusal(col))
    return screened.withColumn("allowed", F.col("reason").isNull())


def extract_sql(df: DataFrame, col: str, out: str = "sql") -> DataFrame:
    """Strip a code fence from model output."""
    return df.withColumn(out, without_fence(col))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order``; a null order comes
    before all others, so a key with null orders only keeps a row as well."""
    rest = [c for c in df.columns if c != key]
    rank = F.struct(F.col(order).isNotNull(), F.col(order))
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(key, *[F.col("_row")[c].alias(c) for c in rest])


def token_cost(df: DataFrame, prices: DataFrame, key: str = "model") -> DataFrame:
    """Add ``cost_usd`` from token counts and prices per million tokens
    (``price_in``, ``price_out``); null for an unlisted model."""
    priced = df.join(prices, key, "left")
    cost = F.col("input_tokens") / F.lit(1e6) * F.col("price_in") + F.col(
        "output_tokens"
    ) / F.lit(1e6) * F.col("price_out")
    return priced.withColumn("cost_usd", cost).drop("price_in", "price_out")


def score(examples: DataFrame, predictions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One scored row per prediction, also where no example has its id.

    ``predictions`` has id, predictor, sql, error (the predictor failed) and
    run_error (its statement failed); ``verdicts`` has id, predictor, matched.
    The first of unknown id, predictor error, refused statement and failed
    statement explains a miss; a plain mismatch has no text.
    """
    gold = known_examples(examples)
    joined = predictions.join(gold, "id", "left").join(verdicts, ["id", "predictor"], "left")
    return judged(joined)


def known_examples(examples: DataFrame, *more: str) -> DataFrame:
    """What ``judged`` needs to know of an example, and ``more`` of its columns."""
    return examples.select("id", "question", "category", F.col("sql").alias("gold_sql"), F.lit(True).alias("known"), *more)


def judged(answers: DataFrame) -> DataFrame:
    """Scored rows of answers that carry their example (``known_examples``, null
    where there is none) and their verdict ``matched``."""
    unknown = F.when(F.col("known").isNull(), F.lit("no example with this id"))
    failed = F.when(F.col("error") != "", F.concat(F.lit("predictor error: "), F.col("error")))
    refused = F.coalesce(refusal("gold_sql"), refusal("sql"))
    explained = F.coalesce(
        unknown,
        failed,
        F.concat(F.lit("rejected unsafe SQL: "), refused),
        F.concat(F.lit("execution error: "), F.col("run_error")),
    )
    scored = answers.withColumn("exec_error", explained)
    correct = F.col("exec_error").isNull() & F.coalesce(F.col("matched"), F.lit(False))
    return scored.withColumn("correct", correct).drop("error", "run_error", "matched", "known")


def _share(col: str = "correct") -> Column:
    return F.coalesce(F.avg(F.col(col).cast("double")), F.lit(0.0))


def accuracy(scored: DataFrame) -> DataFrame:
    """Share of correct rows; 0.0 without rows."""
    return scored.agg(_share().alias("accuracy"))


def accuracy_by_category(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    keys = [*by, "category"]
    return scored.groupBy(*keys).agg(_share().alias("accuracy")).orderBy(*keys)


_MARKS = {"p50": upper_median, "p95": high_index(0.95)}


def latency_stats(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """p50, p95 (values at an index, not interpolated) and mean; zeros
    without rows. Failed calls count. The rows are read twice."""
    rows = keyed(scored, list(by), "latency_ms")
    cells = read_once(rows.groupBy("_g", "_cell").agg(F.count("_v").alias("_n"), F.sum("_v").alias("_sum")))
    mean = cells.groupBy("_g").agg((F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean"))
    joined = mean.join(select_at(rows, cells, _MARKS), "_g", "left")
    if by:
        return joined.select(*[F.col("_g")[c].alias(c) for c in by], "p50", "p95", "mean")
    return joined.agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("p50", "p95", "mean")])


def total_cost(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of the known costs; null if none is known."""
    return scored.groupBy(*by).agg(F.sum("cost_usd").alias("total_cost_usd"))


def cost_per_1k(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Known cost over all calls, those without a cost included."""
    each = F.sum("cost_usd") / F.nullif(F.count("*"), F.lit(0)) * 1000
    return scored.groupBy(*by).agg(each.alias("cost_per_1k_usd"))


def failures(scored: DataFrame) -> DataFrame:
    kept = ["id", "question", "category", "gold_sql", F.col("sql").alias("pred_sql"), "exec_error"]
    extra = ["predictor"] if "predictor" in scored.columns else []
    return scored.where(~F.col("correct")).select(*extra, *kept)


def category_maps(scored: DataFrame) -> DataFrame:
    """(predictor, accuracy_by_category): one map per predictor. It has one
    entry per category, however many rows there are."""
    categories = scored.groupBy("predictor", "category").agg(_share().alias("accuracy"))
    entries = F.array_sort(F.collect_list(F.struct("category", "accuracy")))
    return categories.groupBy("predictor").agg(
        F.map_from_entries(entries).alias("accuracy_by_category")
    )


def report(scored: DataFrame, predictors: DataFrame | None = None) -> DataFrame:
    """One row per predictor. ``predictors`` may list some without any row.

    The failures stay a table of their own (``failures``): as an array in the
    report row they would gather an unbounded group in one task. A null predictor
    is one like any other. The rows are read twice: once for all counts and sums,
    once for the latencies around the wanted places.
    """
    rows = keyed(scored, ["predictor"], "latency_ms")
    sums = {"n": F.count("*"), "hits": F.count_if("correct"), "cost": F.sum("cost_usd"), "latency": F.sum("_v"), "timed": F.count("_v")}
    # The one pass over all rows; what follows works on its few counts.
    counts = read_once(rows.groupBy("_g", "category", "_cell").agg(*[c.alias(name) for name, c in sums.items()]))
    parts = counts.groupBy("_g", "category").agg(*[F.sum(name).alias(name) for name in sums])
    cells = counts.groupBy("_g", "_cell").agg(F.sum("timed").alias("_n"))
    share = (F.col("hits") / F.col("n")).alias("accuracy")
    totals = parts.groupBy("_g").agg(
        (F.sum("hits") / F.sum("n")).alias("accuracy"),
        F.sum("n").alias("n"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", share)))).alias(
            "accuracy_by_category"
        ),
        F.sum("cost").alias("total_cost_usd"),
        (F.sum("latency") / F.nullif(F.sum("timed"), F.lit(0))).alias("mean"),
        (F.sum("n") - F.sum("hits")).alias("n_failures"),
    )
    joined = totals.join(select_at(rows, cells, _MARKS).drop("n"), "_g", "left").withColumn(
        "latency_ms", F.struct(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p50", "p95", "mean")])
    )
    if predictors is not None:
        listed = predictors.select(F.struct("predictor", F.lit(0).alias("_")).alias("_g")).distinct()
        joined = listed.join(joined, "_g", "left")
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("p50", "p95", "mean")])
    no_categories = F.create_map().cast("map<string,double>")
    return joined.select(
        F.col("_g.predictor").alias("predictor"),
        F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("accuracy_by_category", no_categories).alias("accuracy_by_category"),
        F.coalesce("latency_ms", zero).alias("latency_ms"),
        "total_cost_usd",
        (F.col("total_cost_usd") / F.nullif(F.col("n"), F.lit(0)) * 1000).alias("cost_per_1k_usd"),
        F.coalesce("n_failures", F.lit(0)).alias("n_failures"),
    )
