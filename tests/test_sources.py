"""Files in and out."""

import json

from pyspark.sql import functions as F

from tallyframe.functions.values import shift_months
from tallyframe.operators import reporting
from tallyframe.sources import calllog, examples, reports
from tallyframe.sources.tables import load_tables, run, save_tables, table_counts
from tallyframe.streaming.calllog import append_stream, stream_calls


def test_examples_keep_nulls_and_odd_text(spark, tmp_path):
    rows = [("q \"x\"\n", "SELECT 'é'", "c", None, "train-0000"), ("q", "s", "c", 0, "train-0001")]
    df = spark.createDataFrame(rows, examples.EXAMPLE_SCHEMA)
    examples.write_examples(df, str(tmp_path / "ex"))
    got = examples.read_examples(spark, str(tmp_path / "ex")).orderBy("id").collect()
    assert [tuple(r) for r in got] == rows
    lines = [json.loads(x) for f in (tmp_path / "ex").glob("part-*") for x in f.read_text().splitlines()]
    assert {"gold_row_count"} <= set(lines[0]) and len(lines) == 2


def test_nested_reports_from_several_files(spark, tmp_path):
    for name, cats, cost in (("a", {"join": 1.0, "top": 0.5}, None), ("b", {"join": 0.0}, 0.25)):
        body = {
            "predictor": name, "accuracy": 0.5, "n": 2, "accuracy_by_category": cats,
            "latency_ms": {"p50": 1.5, "p95": 2.0, "mean": 1.75},
            "total_cost_usd": cost, "cost_per_1k_usd": cost,
            "failures": [{"id": f"{name}{i}", "question": "q", "category": "join", "gold_sql": "g",
                          "pred_sql": "p", "exec_error": None} for i in range(12)],
        }
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=2))
    df = reports.read_reports(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    cells = {(r.predictor, r.category): r.accuracy for r in reporting.category_rows(df).collect()}
    assert cells == {("a", "join"): 1.0, ("a", "top"): 0.5, ("b", "join"): 0.0}
    assert {r.category for r in reporting.category_names(df).collect()} == {"join", "top"}
    top = reporting.top_failures(reports.report_failures(df)).collect()
    assert len(top) == 20 and {r.remaining for r in top} == {2}
    board = {r.predictor: r.cost_per_1k for r in reporting.leaderboard(df).collect()}
    assert board == {"a": "n/a (no cost data)", "b": "$0.2500"}


def test_call_log_in_batches_and_as_a_stream(spark, tmp_path):
    log, landing = str(tmp_path / "log"), str(tmp_path / "in")
    calls = spark.createDataFrame([("batch", "p", "q")], "source string, predictor string, question string")
    calllog.append_calls(calls, log)
    calllog.append_calls(calls.withColumn("error", F.lit("e")), log)
    got = calllog.read_calls(spark, log).collect()
    assert len(got) == 2 and len({r.id for r in got}) == 2 and {r.latency_ms for r in got} == {0.0}

    stream_log, progress = str(tmp_path / "slog"), str(tmp_path / "progress")
    late = calls.select("*", F.lit("x").alias("id"), F.lit("2024-01-02T03:04:05").alias("ts"))
    for expected in (1, 2):
        late.write.mode("append").json(landing)
        append_stream(stream_calls(spark, landing), stream_log, progress).awaitTermination()
        assert calllog.read_calls(spark, stream_log).count() == expected
    assert str(calllog.read_calls(spark, stream_log).first().day) == "2024-01-02"

    # Batch appends before, between and after the batches of a stream all stay.
    for expected in (3, 4):
        calllog.append_calls(late, stream_log)
        append_stream(stream_calls(spark, landing), stream_log, progress).awaitTermination()
        assert calllog.read_calls(spark, stream_log).count() == expected


def test_tables_and_parameters(spark, tmp_path):
    t = {"a": spark.range(5).withColumn("name", F.lit("it's"))}
    save_tables(t, str(tmp_path))
    loaded = load_tables(spark, str(tmp_path), {"a": "id bigint, name string"})
    assert table_counts(loaded).first() == ("a", 5)
    sql = "SELECT id FROM {a} WHERE name = :name AND id > :least"
    assert [r.id for r in run(spark, sql, loaded, name="it's", least=2).orderBy("id").collect()] == [3, 4]
    assert loaded.using(b="a")["b"].count() == 5


def test_month_shift_runs_over(spark):
    days = ["2026-08-20", "2026-08-31", "2024-08-31", "2026-03-31"]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    got = {r.d: str(r.e) for r in df.select("d", shift_months(F.col("d").cast("date"), -6).alias("e")).collect()}
    assert got == {"2026-08-20": "2026-02-20", "2026-08-31": "2026-03-03",
                   "2024-08-31": "2024-03-02", "2026-03-31": "2025-10-01"}
