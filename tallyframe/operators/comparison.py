"""Compare expected and produced result sets, for one pair or for many examples.

Two results are equal as multisets when every distinct row occurs equally often
on both sides. Equality as sequences is the same test with the position as a part
of the row. Results are compared by fingerprints: gold rows count +1 and predicted
rows -1 in sums over the rows' hashes, which must all be zero. A map task sends
one row per example, so neither a huge result nor many results are shuffled.

``exact=True`` compares the rows themselves instead: the same sums for every
distinct row, with the row in the key, which spreads an example that owns a
third of all rows over all tasks and merges repeated rows before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import asks_for_order
from tallyframe.functions.values import cell_text, round_cell
from tallyframe.operators.fingerprints import chosen, empty, fingerprints


def normalize_rows(df: DataFrame) -> DataFrame:
    """Round every real column to two places."""
    return df.select(
        *[round_cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def pack_cells(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The row as an array of cell texts, by position; names do not matter."""
    fields = [df.schema[c] for c in columns] if columns is not None else df.schema.fields
    return F.array(*[cell_text(F.col(f"`{f.name}`"), f.dataType) for f in fields])


def result_rows(
    df: DataFrame, example: str, side: str, columns: list[str], pos: str | None = None
) -> DataFrame:
    """Long form of one side: (example_id, side, pos, cells)."""
    return df.select(
        F.col(example).alias("example_id"),
        F.lit(side).alias("side"),
        (F.col(pos).cast("bigint") if pos else F.lit(None).cast("bigint")).alias("pos"),
        pack_cells(df, columns).alias("cells"),
    )


def flag_ordered(df: DataFrame, sql: str = "sql") -> DataFrame:
    """Add ``ordered``: the statement asks for a row order."""
    return df.withColumn("ordered", asks_for_order(sql))


def _weight() -> Column:
    return F.when(F.col("side") == "gold", F.lit(1)).otherwise(F.lit(-1)).cast("bigint")


def _unequal(results: DataFrame, *extra: str) -> DataFrame:
    """Examples with at least one row whose counts differ."""
    return (
        results.groupBy("example_id", *extra, "cells")
        .agg(F.sum(_weight()).alias("_w"))
        .where(F.col("_w") != 0)
        .select("example_id")
        .distinct()
    )


def _verdicts(examples: DataFrame, unequal: DataFrame) -> DataFrame:
    marked = unequal.withColumn("_bad", F.lit(True))
    return examples.join(marked, "example_id", "left").select(
        *examples.columns, F.col("_bad").isNull().alias("matched")
    )


def _balanced(examples: DataFrame, results: DataFrame, ordered: Column) -> DataFrame:
    """Verdicts by fingerprint: the weighted sums of both sides cancel out."""
    balance = fingerprints(results, "example_id", weight=_weight())
    matched = chosen(ordered) == empty()
    return examples.join(balance, "example_id", "left").select(*examples.columns, matched.alias("matched"))


def match_unordered(examples: DataFrame, results: DataFrame, exact: bool = False) -> DataFrame:
    """Multiset verdict per row of ``examples`` (with ``example_id``). An
    example without rows on either side matches."""
    if exact:
        return _verdicts(examples, _unequal(results))
    return _balanced(examples, results, F.lit(False))


def match_ordered(examples: DataFrame, results: DataFrame, exact: bool = False) -> DataFrame:
    """Sequence verdict; ``pos`` must be given on both sides."""
    if exact:
        return _verdicts(examples, _unequal(results, "pos"))
    return _balanced(examples, results, F.lit(True))


def match_results(examples: DataFrame, results: DataFrame, exact: bool = False) -> DataFrame:
    """Verdicts for a mix: ``examples`` has ``example_id`` and ``ordered``."""
    if not exact:
        return _balanced(examples, results, F.col("ordered"))
    flagged = results.drop("ordered").join(examples.select("example_id", "ordered"), "example_id")
    return _verdicts(examples, _unequal(flagged.withColumn("_at", F.when(F.col("ordered"), F.col("pos"))), "_at"))


def match_predictors(flags: DataFrame, asked: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Exact verdicts (id, predictor, matched) of ``asked`` (id, predictor), where
    all predictors share the gold rows.

    ``flags``: id, ordered. ``gold``: id, pos, cells. ``predicted``: the same
    with predictor. Gold rows are counted once whatever the number of
    predictors: a result matches when each of its rows occurs as often in gold,
    and both have equally many rows.
    """
    at = F.when(F.col("ordered"), F.col("pos")).alias("_at")
    keys = ["id", "_at", "cells"]
    known = gold.join(flags, "id").select("id", at, "cells").groupBy(*keys).agg(F.count("*").alias("_gold"))
    totals = known.groupBy("id").agg(F.sum("_gold").alias("_all"))
    made = (
        predicted.join(flags, "id").select("id", "predictor", at, "cells")
        .groupBy("predictor", *keys).agg(F.count("*").alias("_made"))
    )
    k, m = known.alias("k"), made.alias("m")
    same_row = [F.col(f"k.{c}").eqNullSafe(F.col(f"m.{c}")) for c in keys]
    differs = F.col("_gold").isNull() | (F.col("_gold") != F.col("_made"))
    sums = (
        m.join(k, same_row, "left").groupBy("m.id", "m.predictor")
        .agg(F.sum("_made").alias("_rows"), F.count_if(differs).alias("_bad"))
    )
    matched = (F.coalesce("_bad", F.lit(0)) == 0) & (F.coalesce("_rows", F.lit(0)) == F.coalesce("_all", F.lit(0)))
    return (
        asked.join(sums, ["id", "predictor"], "left").join(totals, "id", "left")
        .select("id", "predictor", matched.alias("matched"))
    )


def same_result(
    gold: DataFrame, pred: DataFrame, order_by: str | None = None, by: str | None = None, exact: bool = False
) -> DataFrame:
    """One row: do two results agree? ``order_by`` names the position column
    of both sides when the order counts, ``by`` a column of both sides whose
    values are compared one by one, a verdict for each that occurs on either
    side; neither is a cell itself."""

    def side(df: DataFrame, name: str) -> DataFrame:
        cells = [c for c in df.columns if c not in (order_by, by)]
        at = F.col(order_by).cast("bigint") if order_by else F.lit(None).cast("bigint")
        keys = [F.col(by)] if by else []
        return df.select(*keys, F.lit(name).alias("side"), at.alias("pos"), pack_cells(df, cells).alias("cells"))

    both = side(gold, "gold").unionByName(side(pred, "pred"))
    keys = [by] if by else []
    if exact:
        sums = both.groupBy(*keys, "pos", "cells").agg(F.sum(_weight()).alias("_w"))
        return sums.groupBy(*keys).agg((F.count_if(F.col("_w") != 0) == 0).alias("matched"))
    balance = fingerprints(both, *keys, weight=_weight())
    return balance.select(*keys, (chosen(F.lit(order_by is not None)) == empty()).alias("matched"))
