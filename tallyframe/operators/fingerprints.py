"""Fingerprints of result sets that can be added up.

The fingerprint of a set of rows is its row count and the sums of the rows'
hashes, 128 bits in six limbs. Sums do not depend on the order of rows, count
repeated rows as often as they occur, and add: the fingerprint of two parts is
the sum of theirs. So every map task reduces what it has of a result to one row
before the shuffle, however large the result is. With the position mixed into
the hash the same sums compare sequences.

Two different results agree by accident with a chance of about 2**-128 for each
comparison; the hashes are not meant to withstand somebody who looks for such
results. A limb is a number of at most 22 bits, so sums are exact for up to
2**41 rows of one result; more are an error, not a wrong verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CUTS = ((0, 22), (22, 21), (43, 21))  # first bit and width of a hash's limbs
_SEEDS = ("a", "b")
_SUMS = [f"s{i}" for i in range(len(_SEEDS) * len(_CUTS))]


def empty() -> Column:
    """The fingerprint of no rows."""
    return F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("n", *_SUMS)])


def row_hashes(cells: Column) -> list[Column]:
    """Two 64-bit hashes of a row of cell texts. The joined text tells where nulls
    are, which the hash of an array leaves out: a cell starts with its kind,
    a null with a zero character."""
    joined = F.array_join(cells, "\x1f", "\x00")
    return [F.xxhash64(F.lit(seed), cells, F.size(cells), joined) for seed in _SEEDS]


def placed(hashes: list[Column], pos: Column) -> list[Column]:
    """The hashes of a row at a position."""
    return [F.xxhash64(h, pos) for h in hashes]


def summed(hashes: list[Column], weight: Column | None = None) -> Column:
    """The fingerprint as an aggregate: a struct of the count and the sums."""
    times = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    limbs = [F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << width) - 1)) for h in hashes for at, width in _CUTS]
    sums = [F.sum(times), *[F.sum(limb if weight is None else limb * times) for limb in limbs]]
    return F.struct(*[F.coalesce(s, F.lit(0)).alias(c) for c, s in zip(("n", *_SUMS), sums, strict=True)])


def with_hashes(rows: DataFrame) -> DataFrame:
    """Add the row's hashes, alone (``_h0``, ``_h1``) and with its position
    (``_p0``, ``_p1``), to rows of ``cells`` and ``pos``."""
    hashed = rows.withColumns({f"_h{i}": h for i, h in enumerate(row_hashes(F.col("cells")))})
    return hashed.withColumns({f"_p{i}": h for i, h in enumerate(placed([F.col("_h0"), F.col("_h1")], F.col("pos")))})


def fingerprints(rows: DataFrame, *keys: str, weight: Column | None = None) -> DataFrame:
    """One row per key: ``as_set`` and ``as_list``, the fingerprints of its rows
    (``cells``, ``pos``) without and with their positions."""
    return with_hashes(rows).groupBy(*keys).agg(
        summed([F.col("_h0"), F.col("_h1")], weight).alias("as_set"),
        summed([F.col("_p0"), F.col("_p1")], weight).alias("as_list"),
    )


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Fingerprints of whole results from those of their parts."""

    def added(name: str) -> Column:
        return F.struct(*[F.sum(f"{name}.{c}").alias(c) for c in ("n", *_SUMS)]).alias(name)

    return parts.groupBy(*keys).agg(added("as_set"), added("as_list"))


def chosen(ordered: Column | str) -> Column:
    """The fingerprint that counts; a result without rows has the empty one."""
    flag = F.col(ordered) if isinstance(ordered, str) else ordered
    return F.coalesce(F.when(flag, F.col("as_list")).otherwise(F.col("as_set")), empty())
