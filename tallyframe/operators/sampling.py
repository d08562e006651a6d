"""Sampling and expansion that repeat for a seed, whatever the partitioning."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.hashing import order_hash, unit_hash


def weighted_assign(
    df: DataFrame, key: str, values: list, weights: list[float], seed: int, out: str
) -> DataFrame:
    """Give each row one of ``values`` with the given weights."""
    total = float(sum(weights))
    bounds = [b / total for b in accumulate(weights)]
    draw = F.col("_draw")
    choice = F.when(draw < bounds[0], F.lit(values[0]))
    for value, bound in zip(values[1:-1], bounds[1:-1]):
        choice = choice.when(draw < bound, F.lit(value))
    last = F.lit(values[-1])
    chosen = choice.otherwise(last) if len(values) > 1 else last
    return df.withColumn("_draw", unit_hash(seed, key)).withColumn(out, chosen).drop("_draw")


def bernoulli(df: DataFrame, key: str, p: float, seed: int) -> DataFrame:
    """Keep each row with probability ``p``."""
    return df.where(unit_hash(seed, key) < p)


def one_per_group(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """One random row of each group; merged on the map side, so a group of any
    size sends one row per task."""
    rest = [c for c in df.columns if c != group]
    draw = F.struct(order_hash(seed, key), F.col(key))
    picked = df.groupBy(group).agg(F.min_by(F.struct(*rest), draw).alias("_row"))
    return picked.select(group, *[F.col("_row")[c].alias(c) for c in rest])


def expand(df: DataFrame, count_col: str, ordinal: str = "n", block: int = 10_000) -> DataFrame:
    """``count_col`` child rows per row, numbered from 1; none for zero or null.

    Numbers come in blocks, so that a row with a huge count never builds one
    array of that length.
    """
    n = F.col(count_col).cast("bigint")
    step = F.lit(block).cast("bigint")
    starts = F.sequence(F.lit(1).cast("bigint"), n, step)
    blocks = df.where(n > 0).withColumn("_start", F.explode(starts))
    numbers = F.sequence(F.col("_start"), F.least(n, F.col("_start") + step - 1))
    return blocks.withColumn(ordinal, F.explode(numbers)).drop("_start")


def date_between(df: DataFrame, key: str, start: str, end: str, seed: int, out: str) -> DataFrame:
    """A day of the closed interval between two date columns; the first day if
    the interval is empty."""
    first, last = F.col(start).cast("date"), F.col(end).cast("date")
    days = F.greatest(F.datediff(last, first), F.lit(0))
    offset = F.floor(unit_hash(seed, key) * (days + 1)).cast("int")
    return df.withColumn(out, F.date_add(first, offset))
