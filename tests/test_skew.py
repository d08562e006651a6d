"""One key with a third of all rows: results stay whole and no task gets it all."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import comparison as cmp
from tallyframe.operators import positions, reporting, scoring
from tallyframe.plans import workload as w

N = 60_000


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows belong to key 0."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997 + 1)
    return spark.range(N).select("id", key.cast("bigint").alias("key"), (F.col("id") % 1009 / 7).alias("v"))


def test_hot_stratum_is_cut_into_pieces(hot):
    placed = positions.shuffled_positions(hot, "id", 7, ("key",), total="n", piece_rows=500)
    top = placed.where("key = 0").agg(
        F.min("pos"), F.max("pos"), F.countDistinct("pos"), F.max("n")
    ).first()
    assert tuple(top) == (0, N // 3 - 1, N // 3, N // 3)


def test_split_of_a_hot_stratum(hot):
    summary = positions.split_summary(positions.stratified_split(hot, "key", "id", 0.1, 5), "key")
    sizes = {r.key: (r.train + r.eval, r.eval) for r in summary.collect()}
    assert sizes[0] == (N // 3, N // 30) and len(sizes) == 998
    assert all(e == max(1, round(n * 0.1)) for n, e in sizes.values())


def test_hot_predictor(hot):
    scored = hot.select(
        F.format_string("e%06d", "id").alias("id"), F.col("key").cast("string").alias("predictor"),
        F.col("v").alias("latency_ms"), (F.col("id") % 2 == 0).alias("correct"),
        F.lit("c").alias("category"), F.lit("q").alias("question"), F.lit("g").alias("gold_sql"),
        F.lit("s").alias("sql"), F.lit(None).cast("string").alias("exec_error"),
    )
    row = scoring.latency_stats(scored, ("predictor",)).where("predictor = '0'").first()
    values = sorted((i % 1009) / 7 for i in range(0, N, 3))
    assert row.p50 == values[len(values) // 2]
    assert row.p95 == values[int(len(values) * 0.95)]
    top = reporting.top_failures(scoring.failures(scored)).where("predictor = '0'").collect()
    assert sorted(r.id for r in top) == [f"e{i:06d}" for i in range(3, 60, 6)]
    assert {r.total for r in top} == {N // 6}


def test_hot_example(spark, hot):
    gold = cmp.result_rows(hot, "key", "gold", ["v"], "id")
    one_off = hot.withColumn("v", F.when(F.col("id") == 3, 1e6).otherwise(F.col("v")))
    pred = cmp.result_rows(one_off, "key", "pred", ["v"], "id")
    examples = hot.select(F.col("key").alias("example_id")).distinct()
    bad = cmp.match_unordered(examples, gold.unionByName(pred)).where(~F.col("matched"))
    assert [r.example_id for r in bad.collect()] == [0]


def test_hot_customer_is_summed_before_the_shuffle(spark, hot):
    shop = {
        "orders": hot.select(F.col("id").alias("order_id"), F.col("key").alias("customer_id"),
                             F.lit("done").alias("status")),
        "customers": spark.range(998).select(F.col("id").alias("customer_id"),
                                             F.concat(F.lit("c"), F.col("id")).alias("name")),
    }
    df = w.q16_customers_with_more_orders(shop, 1000)
    assert [tuple(r) for r in df.collect()] == [("c0", N // 3)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_skew_join_is_split(spark, hot):
    """With small thresholds the hot partition of a sort-merge join is split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        shop = {
            "orders": hot.repartition(8).select(
                F.col("id").alias("order_id"), F.col("key").alias("customer_id")),
            "customers": spark.range(998).select(
                F.col("id").alias("customer_id"), F.lit("n").alias("name"), F.lit("x").alias("country")),
        }
        df = w.q08_orders_with_customer(shop)
        assert len(df.collect()) == N
        assert "skew" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
