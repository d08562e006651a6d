"""Constraint checks and repeatable samples."""

from pyspark.sql import functions as F

from tallyframe.operators import checks as c
from tallyframe.operators import sampling as s


def _n(df):
    (row,) = df.collect()
    return row.violations


def test_row_rules_ignore_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("z", 9), (None, None)], "t string, n int")
    got = c.check_rows(df, {
        "null": c.is_missing("t"), "domain": c.outside_domain("t", ["a", "b"]),
        "range": c.outside_range("n", 1, 5),
    })
    assert {r.rule: r.violations for r in got.collect()} == {"null": 1, "domain": 1, "range": 1}
    assert {r.violations for r in c.check_not_null(df.limit(0), ["t"], "x").collect()} == {0}


def test_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "k int")
    assert _n(c.check_unique(df, ["k"], "t")) == 2
    assert _n(c.check_primary_key(df, ["k"], "t")) == 4
    assert _n(c.check_unique(df.where("k = 2"), ["k"], "t")) == 0


def test_foreign_key(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 9), (4, 9), (5, 5)], "id int, boss int")
    assert _n(c.check_foreign_key(df, "boss", df, "id", "t")) == 2


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 7)
    one, many = df.repartition(1), df.repartition(9)

    def both(f):
        a, b = (sorted(map(tuple, f(x).collect())) for x in (one, many))
        assert a == b
        return a

    kept = both(lambda x: s.bernoulli(x, "id", 0.3, 42))
    assert 1300 < len(kept) < 1700
    tiers = both(lambda x: s.weighted_assign(x, "id", ["a", "b", "c"], [5, 3, 2], 42, "tier"))
    share = [sum(r[2] == v for r in tiers) / 5000 for v in "abc"]
    assert abs(share[0] - 0.5) < 0.04 and abs(share[2] - 0.2) < 0.04
    picked = both(lambda x: s.one_per_group(x, "g", "id", 42))
    assert [r[0] for r in picked] == list(range(7)) and all(r[1] % 7 == r[0] for r in picked)


def test_expand_and_dates(spark):
    df = spark.createDataFrame([(1, 3), (2, 0), (3, None), (4, 25)], "id int, n int")
    got = s.expand(df, "n", "i", block=10).groupBy("id").agg(
        F.count("*").alias("c"), F.min("i").alias("lo"), F.max("i").alias("hi")
    )
    assert {tuple(r) for r in got.collect()} == {(1, 3, 1, 3), (4, 25, 1, 25)}
    days = spark.range(300).select(
        "id", F.lit("2024-01-01").cast("date").alias("a"), F.lit("2024-01-03").cast("date").alias("b")
    )
    drawn = s.date_between(days, "id", "a", "b", 1, "d")
    assert {str(r.d) for r in drawn.select("d").distinct().collect()} == {
        "2024-01-01", "2024-01-02", "2024-01-03"
    }
    assert drawn.columns == ["id", "a", "b", "d"]
    back = s.date_between(days.limit(5), "id", "b", "a", 1, "d").select("d").distinct().collect()
    assert [str(r.d) for r in back] == ["2024-01-03"]
