"""Settings and the shared folder."""

from tallyframe.session import PARTITION_BYTES, scratch_path, shared_dir, stored, tune


def test_skew_splitting_is_on(spark):
    tune(spark)
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"


def test_the_session_names_the_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_dir(spark)
    assert folder == (named or spark.sparkContext.getCheckpointDir())
    assert spark.sparkContext.getCheckpointDir() is not None
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_stored_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    kept = stored(df, "kept")
    assert kept.dtypes == df.dtypes
    assert sorted(map(tuple, kept.collect())) == [(1, None), (2, "b")]


def test_partitions_for_large_shuffles(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key, None)
    try:
        tune(spark, shuffled_bytes=1 << 20)  # fits in what there is
        assert spark.conf.get(key, None) == before
        tune(spark, shuffled_bytes=100 << 40)
        assert spark.conf.get(key) == str((100 << 40) // PARTITION_BYTES)
        tune(spark)  # what was set stays
        assert spark.conf.get(key) == str((100 << 40) // PARTITION_BYTES)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
