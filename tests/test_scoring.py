"""Statement screen, code fences, scores, order statistics, reports."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import calllog, reporting, scoring
from tallyframe.plans.evaluation import evaluate

STATEMENTS = {
    "select replace(a,b) from t": "word",
    " WITH x as (select 1) select * from x": None,
    "delete from t": "start",
    "select 'drop'": "word",
    "-- c\nselect 1": "start",
    "select updated_at from t": None,
    "SELECT 1; VACUUM": "word",
    "selection": "start",
    "select 1; in\u017fert": "word",
    "select \u0131nsert": "word",
    "select éupdate, inserted": None,
    "select éêç from t": None,
    "": "start",
}


def test_screen(spark):
    df = spark.createDataFrame([(s,) for s in STATEMENTS], "sql string")
    for row in scoring.screen_statements(df, "sql").collect():
        want = STATEMENTS[row.sql]
        assert row.allowed is (want is None), row.sql
        if want == "start":
            assert row.reason == f"SQL must start with SELECT or WITH, got: {row.sql[:60]!r}"
        if want == "word":
            assert row.reason == (
                f"SQL contains a forbidden write/DDL keyword: {row.sql[:120]!r}"
            )


def test_message_keeps_a_prefix(spark):
    sql = "drop " + "x" * 100
    row = scoring.screen_statements(spark.createDataFrame([(sql,)], "sql string"), "sql").first()
    assert row.reason.endswith(f"{sql[:60]!r}")


FENCED = {
    "SELECT 1": "SELECT 1",
    "  SELECT 1 \n": "SELECT 1",
    "```sql\nSELECT 1\n```": "SELECT 1",
    "```\nSELECT 1\n```": "SELECT 1",
    " \n```sql\nSELECT 1\n  ```  \n": "SELECT 1",
    "```sql\nSELECT 1": "SELECT 1",
    "```sql\nSELECT 1\n\nFROM t\n``` thanks": "SELECT 1\n\nFROM t",
    "```": "",
    "```sql": "",
    "```\n```": "",
    "```sql SELECT 1```": "",
    "SELECT '```'": "SELECT '```'",
    "a\n```sql\nSELECT 1\n```": "a\n```sql\nSELECT 1\n```",
    " SELECT 1 ": "SELECT 1",
    "": "",
}


def test_fences(spark):
    df = spark.createDataFrame([(s,) for s in FENCED], "answer string")
    got = {r.answer: r.sql for r in scoring.extract_sql(df, "answer").collect()}
    assert got == FENCED


def test_score_precedence(spark):
    examples = spark.createDataFrame(
        [(i, f"q{i}", "join", "SELECT 1") for i in range(7)] + [(7, "q7", "join", "DROP x")],
        "id int, question string, category string, sql string",
    )
    predictions = spark.createDataFrame(
        [
            (0, "p", "SELECT 1", None, None),
            (1, "p", "SELECT 1", "", None),
            (2, "p", "DROP t", "timeout", "boom"),
            (3, "p", "DROP t", None, "boom"),
            (4, "p", "SELECT 1", None, "boom"),
            (5, "p", "SELECT 2", None, None),
            (6, "p", "SELECT 3", None, None),
            (7, "p", "SELECT 3", None, None),
        ],
        "id int, predictor string, sql string, error string, run_error string",
    )
    verdicts = spark.createDataFrame(
        [(i, "p", i != 5) for i in range(8) if i != 6], "id int, predictor string, matched boolean"
    )
    got = {
        r.id: (r.correct, r.exec_error)
        for r in scoring.score(examples, predictions, verdicts).collect()
    }
    assert got == {
        0: (True, None),
        1: (True, None),
        2: (False, "predictor error: timeout"),
        3: (False, "rejected unsafe SQL: SQL must start with SELECT or WITH, got: 'DROP t'"),
        4: (False, "execution error: boom"),
        5: (False, None),
        6: (False, None),
        7: (False, "rejected unsafe SQL: SQL must start with SELECT or WITH, got: 'DROP x'"),
    }


SCORED = (
    "id string, predictor string, category string, question string, gold_sql string, sql string, "
    "latency_ms double, cost_usd double, correct boolean, exec_error string"
)


def _scored(spark, latencies, predictor="p", cost=None):
    rows = [
        (f"e{i:04d}", predictor, f"c{i % 3}", "q", "g", "s", v, cost, i % 4 != 0, None)
        for i, v in enumerate(latencies)
    ]
    return spark.createDataFrame(rows, SCORED)


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 28, 500])
def test_latency_by_index(spark, n):
    rng = random.Random(n)
    values = [round(rng.lognormvariate(5, 2), 3) for _ in range(n)]
    row = scoring.latency_stats(_scored(spark, values)).first()
    ordered = sorted(values)
    assert row.p50 == ordered[n // 2]
    assert row.p95 == ordered[min(n - 1, int(n * 0.95))]
    assert row["mean"] == pytest.approx(sum(values) / n)


def test_latency_of_hostile_values(spark):
    """Negative, zero, tiny, huge and one value that fills a third."""
    rng = random.Random(5)
    values = [7.25] * 400 + [0.0] * 100 + [-rng.random() for _ in range(150)]
    values += [10.0 ** rng.uniform(-9, 12) for _ in range(550)]
    row = scoring.latency_stats(_scored(spark, values)).first()
    ordered = sorted(values)
    assert (row.p50, row.p95) == (ordered[600], ordered[1140])


def test_no_rows(spark):
    none = _scored(spark, [])
    assert tuple(scoring.latency_stats(none).first()) == (0.0, 0.0, 0.0)
    assert scoring.accuracy(none).first().accuracy == 0.0
    assert scoring.total_cost(none).first().total_cost_usd is None
    assert scoring.cost_per_1k(none).first().cost_per_1k_usd is None
    assert scoring.report(none).count() == 0
    known = spark.createDataFrame([("p",)], "predictor string")
    row = scoring.report(none, known).first()
    assert (row.accuracy, row.n, row.accuracy_by_category, tuple(row.latency_ms)) == (
        0.0, 0, {}, (0.0, 0.0, 0.0)
    )


def test_costs_with_gaps(spark):
    df = _scored(spark, [1.0] * 3, cost=0.5).unionByName(_scored(spark, [1.0] * 2))
    assert scoring.total_cost(df).first().total_cost_usd == 1.5
    assert scoring.cost_per_1k(df).first().cost_per_1k_usd == 300.0


def test_report_and_tables(spark):
    df = _scored(spark, [float(i) for i in range(28)], "a", 0.001).unionByName(
        _scored(spark, [5.5, 6.5], "b")
    )
    reports = {r.predictor: r for r in scoring.report(df).collect()}
    a, b = reports["a"], reports["b"]
    assert (a.n, a.n_failures, a.accuracy) == (28, 7, 21 / 28)
    assert tuple(a.latency_ms) == (14.0, 26.0, 13.5)
    assert b.total_cost_usd is None and set(b.accuracy_by_category) == {"c0", "c1"}

    board = {r.predictor: r for r in reporting.leaderboard(scoring.report(df)).collect()}
    assert board["a"].asDict() == {
        "predictor": "a", "accuracy": "75.0%", "n": 28, "p50_ms": "14", "p95_ms": "26",
        "cost_per_1k": "$1.0000",
    }
    assert board["b"].cost_per_1k == "n/a (no cost data)" and board["b"].p50_ms == "6"

    matrix = {r.category: (r.a, r.b) for r in reporting.category_matrix(scoring.report(df)).collect()}
    assert matrix["c2"][1] is None and matrix["c0"][1] == 0.0

    top = reporting.top_failures(scoring.failures(df), 3).where("predictor = 'a'").collect()
    assert [r.id for r in sorted(top, key=lambda r: r.place)] == ["e0000", "e0004", "e0008"]
    assert {(r.total, r.remaining) for r in top} == {(7, 4)}


def test_token_cost(spark):
    used = spark.createDataFrame(
        [("m", 1_000_000, 200_000), ("other", 5, 5), ("m", None, 5)],
        "model string, input_tokens bigint, output_tokens bigint",
    )
    prices = spark.createDataFrame([("m", 1.0, 5.0)], "model string, price_in double, price_out double")
    got = [r.cost_usd for r in scoring.token_cost(used, prices).orderBy("model", "input_tokens").collect()]
    assert got == [None, 2.0, None]


CALLS = "predictor string, latency_ms double, cost_usd double, error string"


def test_call_statistics(spark):
    calls = spark.createDataFrame(
        [("a", 10.04, None, None), ("a", 10.1, 0.0000014, "x"), ("a", 10.2, None, None),
         ("zero", 0.0, None, "x")],
        CALLS,
    )
    assert calllog.stats(calls, "a").first() == ("a", 3, 10.1, 0.667, 0.000001)
    assert calllog.stats(calls, "zero").first() == ("zero", 1, None, 0.0, 0.0)
    assert calllog.stats(calls, "nobody").first() == ("nobody", 0, None, None, 0.0)
    assert calllog.stats(calls, "").first()[:2] == ("all", 4)
    assert {r.predictor: r.n_calls for r in calllog.stats_by_predictor(calls).collect()} == {
        "a": 3, "zero": 1, "all": 4
    }


def test_last_wins(spark):
    df = spark.createDataFrame([("q", 1, "a"), ("q", 3, "c"), ("q", 2, "b"), ("r", 1, None)],
                               "question string, n int, sql string")
    got = {r.question: r.sql for r in scoring.last_wins(df, "question", "n").collect()}
    assert got == {"q": "c", "r": None}


def test_preview_and_cap(spark):
    rows = [("e", i, [f"n:{i}"]) for i in range(8)] + [("f", 0, ["n:1"])]
    results = spark.createDataFrame(rows, "example_id string, pos bigint, cells array<string>")
    got = {r.example_id: r for r in reporting.preview(results, 6).collect()}
    assert [c[0] for c in got["e"].result_rows] == [f"n:{i}" for i in range(6)]
    assert (got["e"].result_row_count, got["e"].result_truncated) == (8, True)
    assert (got["f"].result_row_count, got["f"].result_truncated) == (1, False)
    capped = reporting.capped(spark.range(10), 3, ["id"]).collect()
    assert [tuple(r) for r in capped] == [(0, 10, True), (1, 10, True), (2, 10, True)]


def test_gold_scores_all_and_nonsense_none(spark):
    """A predictor that returns the expected rows must reach 100 %, one that
    returns a single zero must stay at 0 %."""
    examples = spark.createDataFrame(
        [(i, f"q{i}", "c", "SELECT a FROM t ORDER BY a" if i % 2 else "SELECT a FROM t") for i in range(6)],
        "id int, question string, category string, sql string",
    )
    predictions = spark.createDataFrame(
        [(i, p, "SELECT 1", None, None) for i in range(6) for p in ("gold", "zero")],
        "id int, predictor string, sql string, error string, run_error string",
    )
    gold = [(i, k, [f"n:{k}00"]) for i in range(1, 6) for k in range(1, i + 1)]
    rows = spark.createDataFrame(gold, "id int, pos bigint, cells array<string>")
    zero = spark.createDataFrame([(i, 1, ["n:0"]) for i in range(6)], rows.schema)
    predicted = rows.withColumn("predictor", F.lit("gold")).unionByName(
        zero.withColumn("predictor", F.lit("zero"))
    )
    scored = evaluate(examples, predictions, rows, predicted)
    got = {r.predictor: r.share for r in scored.groupBy("predictor").agg(
        F.avg(F.col("correct").cast("int")).alias("share")).collect()}
    assert got == {"gold": 1.0, "zero": 0.0}
