"""Shuffles, splits and ids against a plain sort of the same hashes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import positions as p


def _hash(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


def test_position_is_the_rank_of_the_hash(spark):
    keys = range(3000)
    want = {k: i for i, k in enumerate(sorted(keys, key=lambda k: (_hash(7, k), k)))}
    df = spark.range(3000).withColumnRenamed("id", "key")
    for layout in (df.repartition(1), df.repartition(8)):
        got = p.shuffled_positions(layout, "key", 7, piece_rows=40).collect()
        assert {r.key: r.pos for r in got} == want
    ids = {r.key: r.id for r in p.assign_ids(df, "train", "key", 7).collect()}
    assert ids == {k: f"train-{i:04d}" for k, i in want.items()}
    batches = {r.key: r.batch for r in p.assign_batches(df, "key", 16, 7).collect()}
    assert batches == {k: i // 16 for k, i in want.items()}


@pytest.mark.parametrize("most_limits", [100_000, 2])
def test_split_sizes_and_members(spark, monkeypatch, most_limits):
    """Strata of 1, 2, 22 and 44 rows, one of them null; one holds most rows.
    Limits are broadcast for few strata and joined for many."""
    sizes = {"a": 1, "b": 2, None: 22, "d": 44, "hot": 500}
    rows = [(s, f"{s}{i}") for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "stratum string, key string")
    monkeypatch.setattr(p, "MOST_LIMITS", most_limits)
    marked = p.stratified_split(df, "stratum", "key", 0.2, 7).collect()
    assert len(marked) == len(rows)
    for stratum, n in sizes.items():
        chosen = {r.key for r in marked if r.stratum == stratum and r.split == "eval"}
        members = [k for s, k in rows if s == stratum]
        first = sorted(members, key=lambda k: (_hash(7, k), k))[: max(1, round(n * 0.2))]
        assert chosen == set(first)


def test_quota_rounds_half_to_even(spark):
    rows = [(n, f"{n}-{i}") for n in (2, 6, 10) for i in range(n)]
    df = spark.createDataFrame(rows, "stratum int, key string")
    summary = p.split_summary(p.stratified_split(df, "stratum", "key", 0.25, 1), "stratum")
    assert {r.stratum: (r.train, r.eval) for r in summary.collect()} == {
        2: (1, 1), 6: (4, 2), 10: (8, 2)
    }


def test_split_of_rows_that_share_leading_digits(spark, monkeypatch):
    """All rows in one cell of either digit, so that the last step decides."""
    monkeypatch.setattr(p, "order_hash", lambda seed, key: F.concat(F.lit("00000000"), F.md5(F.col(key).cast("string"))))
    rows = [("a", i) for i in range(200)] + [("b", i) for i in range(31)]
    marked = p.stratified_split(spark.createDataFrame(rows, "s string, k int").repartition(4), "s", "k", 0.3, 1).collect()
    for s, n, quota in (("a", 200, 60), ("b", 31, 9)):
        first = sorted(range(n), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:quota]
        assert {r.k for r in marked if r.s == s and r.split == "eval"} == set(first)
    assert p.stratified_split(spark.createDataFrame([], "s string, k int"), "s", "k", 0.3, 1).count() == 0


def test_ids_keep_all_digits(spark):
    row = spark.range(1).select(
        F.lit(123456).alias("n")
    ).select(p.padded_id(F.lit("eval"), "n").alias("id")).first()
    assert row.id == "eval-123456"
