"""Repeatable shuffles, ordinals, splits and ids.

The order is the order of a hash of the key. A window over a whole table (or a
whole stratum) would sort it in one task, so rows are first cut by the leading
hex digits of the hash: the ordinal is the number of rows in earlier cuts plus
the rank inside the cut. Hashes spread evenly, hence a stratum that holds a
third of the table falls into even pieces, as many as its size asks for; a small
stratum stays in one. The only window that is not cut runs over piece counts, at
most 16**5 per stratum.

A split needs no ranks: one comparison with the hash of the last row that belongs
to the smaller part, found by counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.hashing import order_hash
from tallyframe.functions.text import padded_id
from tallyframe.operators.ordinals import hit_in

PIECE_ROWS = 50_000
_MAX_DIGITS = 5
_MAX_BIG = 50_000
MOST_LIMITS = 100_000

_HASH, _GROUP, _PIECE, _RANK = "_hash", "_group", "_piece", "_rank"
_DIGITS, _COUNT, _BEFORE, _TOTAL = "_digits", "_count", "_before", "_total"


def digits_for(rows: Column, piece_rows: int) -> Column:
    """Hex digits that cut so many rows into pieces of about ``piece_rows``."""
    pieces = F.greatest(rows / F.lit(piece_rows), F.lit(1.0))
    return F.least(F.ceil(F.log(16.0, pieces)), F.lit(_MAX_DIGITS)).cast("int")


def _with_digits(df: DataFrame, within: tuple[str, ...], piece_rows: int) -> DataFrame:
    """Add the group as one struct (which joins null groups too) and the number
    of digits that cut it."""
    grouped = df.withColumn(_GROUP, F.struct(*[F.col(c) for c in within], F.lit(0).alias("_")))
    if not within:
        total = df.agg(F.count("*")).scalar()
        return grouped.withColumn(_DIGITS, digits_for(total, piece_rows))
    sizes = grouped.groupBy(_GROUP).agg(F.count("*").alias(_COUNT))
    total = sizes.agg(F.sum(_COUNT)).scalar()
    # Fewer than _MAX_BIG groups can hold more than 1/_MAX_BIG of the rows
    # each: that bounds what is broadcast.
    share = F.greatest(F.lit(float(piece_rows)), total / F.lit(float(_MAX_BIG)))
    big = sizes.where(F.col(_COUNT) > share).select(
        _GROUP, digits_for(F.col(_COUNT), piece_rows).alias(_DIGITS)
    )
    return grouped.join(F.broadcast(big), _GROUP, "left").na.fill(0, [_DIGITS])


def shuffled_positions(
    df: DataFrame,
    key: str,
    seed: int,
    within: tuple[str, ...] = (),
    position: str = "pos",
    total: str | None = None,
    piece_rows: int | None = None,
    in_order: bool = False,
) -> DataFrame:
    """Add the 0-based place of each row in the seeded shuffle.

    ``key`` must be unique within each group of ``within``. ``total`` names an
    optional column for the size of the group. ``in_order`` also returns the
    rows ordered by group and place: pieces are then dealt by range, which the
    ranks and the order share, so the rows are still shuffled once.
    """
    hashed = df.withColumn(_HASH, order_hash(seed, key))
    sized = _with_digits(hashed, within, piece_rows or PIECE_ROWS)
    cut = F.substr(F.col(_HASH), F.lit(1), F.col(_DIGITS))
    rows = sized.withColumn(_PIECE, F.struct(F.col(_GROUP), cut.alias("cut"))).drop(_GROUP, _DIGITS)

    group = F.col(_PIECE)[_GROUP]
    ordered = Window.partitionBy(group).orderBy(F.col(_PIECE)["cut"])
    pieces = rows.groupBy(_PIECE).agg(F.count("*").alias(_COUNT)).select(
        _PIECE,
        (F.sum(_COUNT).over(ordered) - F.col(_COUNT)).alias(_BEFORE),
        F.sum(_COUNT).over(Window.partitionBy(group)).alias(_TOTAL),
    )

    # Ranked before the join: the one shuffle of the rows is by piece, and the
    # small side that follows may be broadcast or merged as it comes.
    if in_order:
        rows = rows.repartitionByRange(_PIECE)
    rank = F.row_number().over(Window.partitionBy(_PIECE).orderBy(_HASH, key))
    ranked = rows.withColumn(_RANK, rank)
    if in_order and not within:
        pieces = F.broadcast(pieces)  # at most 16**_MAX_DIGITS rows of two numbers
    placed = ranked.join(pieces, _PIECE).withColumn(
        position, F.col(_BEFORE) + F.col(_RANK) - F.lit(1)
    )
    if in_order:
        placed = placed.orderBy(_PIECE, _HASH, key)
    if total is not None:
        placed = placed.withColumn(total, F.col(_TOTAL))
    return placed.drop(_HASH, _PIECE, _RANK, _BEFORE, _TOTAL)


def ordered_positions(df: DataFrame, within: str, order: list[Column], cut: list[Column], position: str = "pos") -> DataFrame:
    """Add the 0-based place of each row among the rows with its ``within``, by
    ``order``, which has no ties.

    ``cut`` are columns that never decrease along the order; they cut a large
    group into pieces. Rows are ranked in their piece, after the rows of earlier
    pieces, so a window over a whole group sees piece counts only.
    """
    rows = df.withColumn(_PIECE, F.struct(F.col(within).alias("_of"), *[c.alias(f"c{i}") for i, c in enumerate(cut)]))
    counts = rows.groupBy(_PIECE).agg(F.count("*").alias(_COUNT))
    earlier = Window.partitionBy(F.col(_PIECE)["_of"]).orderBy(_PIECE)
    pieces = counts.select(_PIECE, (F.sum(_COUNT).over(earlier) - F.col(_COUNT)).alias(_BEFORE))
    ranked = rows.withColumn(_RANK, F.row_number().over(Window.partitionBy(_PIECE).orderBy(*order)))
    placed = ranked.join(pieces, _PIECE).withColumn(position, F.col(_BEFORE) + F.col(_RANK) - 1)
    return placed.drop(_PIECE, _RANK, _BEFORE)


def seeded_shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in shuffled order, with their place in ``pos``."""
    return shuffled_positions(df, key, seed, in_order=True)


def _digit(number: int) -> Column:
    """The ``number``-th group of four hex digits of the hash, as a number."""
    return F.conv(F.substring(_HASH, 4 * number + 1, 4), 16, 10).cast("bigint")


def hash_limits(rows: DataFrame, key: str, quota, few: bool) -> DataFrame:
    """(_group, _limit): the quota-th smallest (hash, key) of each group.

    ``rows`` carry ``_group`` and ``_hash``; ``quota`` maps the size of a group to
    a number from 1 to that size. A count by leading digits tells the cell of the
    wanted row, a second one over the rows of that cell its next digits; of the
    rows that agree in all eight, one in four thousand million, the row is
    picked. ``few`` groups: the cells are broadcast, and no row is shuffled but
    those of the wanted cells.
    """
    def looked_up(small: DataFrame) -> DataFrame:
        return F.broadcast(small) if few else small

    counts = rows.groupBy(_GROUP, _digit(0).alias("k")).agg(F.count("*").alias("n"))
    sizes = counts.groupBy(_GROUP).agg(F.sum("n").alias(_TOTAL), F.collect_list(F.struct("k", "n")).alias("_cells"))
    wanted = sizes.withColumn("_at", (quota(F.col(_TOTAL)) - 1).cast("bigint")).withColumn("_hit", hit_in("_cells", "_at")).select(
        _GROUP, F.col("_hit.k").alias("_cell"), (F.col("_at") - F.col("_hit.before")).alias("_at")
    )
    near = rows.select(_GROUP, _HASH, key, _digit(0).alias("_cell")).join(looked_up(wanted), [_GROUP, "_cell"])
    parts = near.groupBy(_GROUP, "_at", _digit(1).alias("k")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(_HASH).alias("hash"), F.col(key).alias("key")))).alias("_members")
    )
    chosen = parts.groupBy(_GROUP, "_at").agg(F.collect_list(F.struct("k", "n")).alias("_cells")).withColumn("_hit", hit_in("_cells", "_at"))
    chosen = chosen.select(_GROUP, F.col("_hit.k").alias("k"), (F.col("_at") - F.col("_hit.before")).cast("int").alias("_nth"))
    return parts.join(chosen, [_GROUP, "k"]).select(_GROUP, F.expr("_members[_nth]").alias("_limit"))


def stratified_split(
    df: DataFrame,
    strata: str,
    key: str,
    fraction: float,
    seed: int,
    column: str = "split",
) -> DataFrame:
    """Mark each row 'eval' or 'train'.

    Every stratum gives round-half-even(size * fraction) rows, one at least: those
    up to its quota-th smallest hash. No row is ranked or shuffled for that, a
    comparison with the stratum's limit decides. The limits are broadcast if a
    look at the strata's column finds at most ``MOST_LIMITS`` of them; else they
    are joined.
    """
    few = df.select(strata).distinct().limit(MOST_LIMITS + 1).count() <= MOST_LIMITS
    rows = df.withColumns({_HASH: order_hash(seed, key), _GROUP: F.struct(F.col(strata), F.lit(0).alias("_"))})

    def quota(size: Column) -> Column:
        return F.greatest(F.lit(1), F.bround(size * F.lit(fraction), 0).cast("bigint"))

    limits = hash_limits(rows, key, quota, few)
    marked = rows.join(F.broadcast(limits) if few else limits, _GROUP)
    within = F.struct(F.col(_HASH).alias("hash"), F.col(key).alias("key")) <= F.col("_limit")
    return marked.withColumn(column, F.when(within, F.lit("eval")).otherwise(F.lit("train"))).drop(_HASH, _GROUP, "_limit")


def split_summary(df: DataFrame, strata: str, column: str = "split") -> DataFrame:
    """Rows of each stratum in either part."""
    return (
        df.groupBy(strata)
        .pivot(column, ["train", "eval"])
        .agg(F.count(F.lit(1)))
        .na.fill(0, ["train", "eval"])
    )


def assign_ids(
    df: DataFrame, prefix: str | Column, key: str, seed: int, within: tuple[str, ...] = ()
) -> DataFrame:
    """Give each row an id ``prefix-0000`` in shuffled order. With ``within``
    the numbering starts anew in each part, such as train and eval."""
    label = F.lit(prefix) if isinstance(prefix, str) else prefix
    placed = shuffled_positions(df, key, seed, within)
    return placed.withColumn("id", padded_id(label, "pos"))


def assign_batches(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """Number the batches of ``size`` rows of a shuffled pass over the table."""
    placed = shuffled_positions(df, key, seed)
    return placed.withColumn("batch", F.floor(F.col("pos") / F.lit(size)))
