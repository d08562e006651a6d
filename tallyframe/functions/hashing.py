"""Repeatable hashes that do not depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_hash(seed: int, *keys: str | Column) -> Column:
    """Hex text whose order is the shuffled order of the rows."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def unit_hash(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) drawn from the first 32 bits of the hash."""
    head = F.substring(order_hash(seed, *keys), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(4294967296.0)
