"""Relational division: who is paired with every needed value.

Needed values are numbered, and what a key has is a bitmap: the row (key, word,
bits) tells which of 64 numbers it has. Bitmaps merge by a bitwise or, on the map
side as well, so repeated pairs cost nothing and no pair is made distinct. A key
with few values costs a row each, as the pairs did; one with a third of all pairs
has a row per 64 needed values and map task, dealt by word to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.hashing import order_hash
from tallyframe.operators.positions import PIECE_ROWS, digits_for

_SEED = 0


def numbered(needed: DataFrame, value: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(value, ordinal): the different values with a number each, nulls left out.

    Values are cut by leading digits of their hash into pieces of about
    ``piece_rows`` and ranked in their piece; the upper half of a number is its
    piece. Numbers follow the hashes, so they are the same whenever a task runs
    again, and nothing is joined, so a small set is still seen to be small.
    """
    known = needed.select(value).where(F.col(value).isNotNull()).distinct()
    digits = digits_for(known.agg(F.count("*")).scalar(), piece_rows)
    cut = known.withColumn("_hash", order_hash(_SEED, value)).withColumn("_piece", F.substr(F.col("_hash"), F.lit(1), digits))
    rank = F.row_number().over(Window.partitionBy("_piece").orderBy("_hash", value)) - 1
    piece = F.coalesce(F.conv("_piece", 16, 10).cast("bigint"), F.lit(0))
    return cut.select(value, (F.shiftleft(piece, 32) + rank).alias("ordinal"))


def bitmaps(pairs: DataFrame, key: str) -> DataFrame:
    """(key, word, bits) of ``pairs`` (key, ordinal)."""
    marked = pairs.select(
        key,
        F.shiftright("ordinal", 6).alias("word"),
        F.expr("shiftleft(1L, CAST(ordinal & 63 AS INT))").alias("bits"),
    )
    return marked.groupBy(key, "word").agg(F.bit_or("bits").alias("bits"))


def holders(candidates: DataFrame, maps: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """Candidates whose bitmaps are full; with nothing in ``needed`` (as from
    ``numbered``), all of them."""
    counts = maps.groupBy(key).agg(F.sum(F.bit_count("bits")).alias("_covered"))
    total = needed.agg(F.count("*")).scalar()
    full = F.coalesce(F.col("_covered"), F.lit(0)) == total
    return candidates.join(counts, key, "left").where(full).drop("_covered")


def divide(candidates: DataFrame, pairs: DataFrame, needed: DataFrame, key: str, value: str) -> DataFrame:
    """Candidates whose ``pairs`` cover all of ``needed``; with nothing needed,
    all of them. Null values are neither needed nor met, null keys meet nothing.

    No candidate is multiplied by the needed set.
    """
    ordinals = numbered(needed, value)
    met = pairs.select(key, value).join(ordinals, value)
    return holders(candidates, bitmaps(met, key), ordinals, key)
