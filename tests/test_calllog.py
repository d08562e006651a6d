"""The call log: repeatable appends, a stream that starts again, compaction."""

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import calllog as stats
from tallyframe.sources import calllog as log
from tallyframe.streaming import calllog as streaming


def _calls(spark, first, n, predictor="p"):
    return spark.range(first, first + n).select(
        F.format_string("c%05d", "id").alias("id"), F.lit("batch").alias("source"), F.lit(predictor).alias("predictor"), F.lit("q").alias("question"),
        (F.col("id") % 13).cast("double").alias("latency_ms"), F.when(F.col("id") % 5 == 0, "e").alias("error"),
        F.when(F.col("id") % 3 != 0, F.col("id") / 1000).alias("cost_usd"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") % 60).cast("int"))).alias("ts"),
    )


def _ids(spark, path):
    return sorted(r["id"] for r in log.read_calls(spark, path).select("id").collect())


def test_an_append_that_failed_is_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    assert log.append_calls(_calls(spark, 0, 10), path, "a")

    def fails(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(log, "_commit", fails)
        with pytest.raises(OSError):
            log.append_calls(_calls(spark, 10, 10), path, "b")
    assert _ids(spark, path) == [f"c{i:05d}" for i in range(10)]  # rows without a commit are not seen
    assert log.append_calls(_calls(spark, 10, 10), path, "b")
    assert not log.append_calls(_calls(spark, 10, 10), path, "b")  # the caller did not hear of the success
    assert _ids(spark, path) == [f"c{i:05d}" for i in range(20)]
    # Two writers with one token, neither of which saw the other.
    for _ in range(2):
        folder = log._write(log.as_calls(_calls(spark, 20, 5)), path, "c")
        log._commit(spark, path, "c", folder, [])
    assert _ids(spark, path) == [f"c{i:05d}" for i in range(25)] and log.unused_folders(spark, path).count() == 1


def test_empty_logs_and_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    assert log.read_calls(spark, path).count() == 0
    log.append_calls(_calls(spark, 0, 0), path, "nothing")
    assert log.read_calls(spark, path).count() == 0
    assert log.append_calls(_calls(spark, 0, 3), path, "something") and len(_ids(spark, path)) == 3


def test_a_repeated_batch_of_a_stream_counts_once(spark, tmp_path):
    path, landing, progress = (str(tmp_path / n) for n in ("log", "in", "progress"))
    for first in (0, 8):
        _calls(spark, first, 8).write.mode("append").json(landing)
        streaming.append_stream(streaming.stream_calls(spark, landing), path, progress).awaitTermination()
    # The second batch ran, but the stream stopped before it could note that.
    (tmp_path / "progress" / "commits" / "1").rename(tmp_path / "lost")
    for crc in (tmp_path / "progress" / "commits").glob(".1.crc"):
        crc.rename(tmp_path / "lost.crc")
    streaming.append_stream(streaming.stream_calls(spark, landing), path, progress).awaitTermination()
    log.append_calls(_calls(spark, 16, 4), path)
    assert _ids(spark, path) == [f"c{i:05d}" for i in range(20)]


def test_compaction_while_reading(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(5):
        log.append_calls(_calls(spark, 10 * i, 10, "pq"[i % 2]), path)
    log.append_calls(_calls(spark, 50, 100), path)
    before = log.read_calls(spark, path)
    sums = sorted(tuple(r) for r in stats.stats_by_predictor(log.live_sums(spark, path), sums=True).collect())
    assert len(log.compact_calls(spark, path, small_rows=50)) == 5
    assert before.count() == 150 and _ids(spark, path) == [f"c{i:05d}" for i in range(150)]
    assert log.live_sums(spark, path).select("folder").distinct().count() == 2
    assert sorted(tuple(r) for r in stats.stats_by_predictor(log.live_sums(spark, path), sums=True).collect()) == sums
    assert log.compact_calls(spark, path, small_rows=20) == [] and log.unused_folders(spark, path).count() == 5
    # The compacted folder is an ordinary one: it is compacted again with the next.
    log.append_calls(_calls(spark, 150, 10), path)
    assert len(log.compact_calls(spark, path)) == 3 and len(_ids(spark, path)) == 160


def test_days_are_pruned(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(2):
        log.append_calls(_calls(spark, 60 * i, 60), path)
    df = log.read_calls(spark, path).where("day = DATE'2024-01-02'")
    assert df.count() == 48 and len(df.inputFiles()) >= 2
    assert "PartitionFilters: [isnotnull(day" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_statistics_from_commits(spark, tmp_path, order):
    path = str(tmp_path / "log")
    parts = [_calls(spark, 0, 30), _calls(spark, 30, 20, "q"), _calls(spark, 50, 7, "r").withColumn("latency_ms", F.lit(None).cast("double"))]
    for i in order:
        log.append_calls(parts[i], path, f"t{i}")
        log.append_calls(parts[i], path, f"t{i}")
    calls, sums = log.read_calls(spark, path), log.live_sums(spark, path)
    assert sorted(map(str, stats.stats_by_predictor(sums, sums=True).collect())) == sorted(map(str, stats.stats_by_predictor(calls).collect()))
    for who in ("p", "r", "nobody", ""):
        assert stats.stats(sums, who, sums=True).first() == stats.stats(calls, who).first()
    assert "parquet" not in stats.stats(sums, sums=True)._jdf.queryExecution().executedPlan().toString().lower()


def test_broken_lines(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    good = {"id": "1", "ts": "2024-01-01T00:00:00", "source": "s", "predictor": "p", "question": "q"}
    (landing / "a.json").write_text("\n".join([json.dumps(good), "{broken", json.dumps({**good, "id": "2", "latency_ms": "soon"}), '{"id": "3"']))
    with pytest.raises(Exception, match="(?i)malformed"):
        streaming.append_stream(streaming.stream_calls(spark, str(landing)), str(tmp_path / "l1"), str(tmp_path / "p1")).awaitTermination()
    assert log.read_calls(spark, str(tmp_path / "l1")).count() == 0

    def run(name, most):
        streaming.append_stream(streaming.stream_calls(spark, str(landing), broken=True), str(tmp_path / name), str(tmp_path / f"{name}-p"),
                                most_broken=most).awaitTermination()

    run("l2", 3)
    assert _ids(spark, str(tmp_path / "l2")) == ["1"]
    aside = streaming.read_broken(spark, str(tmp_path / "l2")).collect()
    assert sorted(r["line"] for r in aside)[2] == "{broken" and len(aside) == 3 and all(r["file"].endswith("a.json") for r in aside)
    with pytest.raises(Exception, match="more than 2 broken"):
        run("l3", 2)
    assert log.read_calls(spark, str(tmp_path / "l3")).count() == 0
