"""Every example is scored once for every predictor."""

from tallyframe.plans.evaluation import evaluate


def test_missing_doubled_unknown_and_null_statements(spark):
    examples = spark.createDataFrame(
        [(1, "q1", "a", "SELECT 1"), (2, "q2", "b", "SELECT 2 ORDER BY 1"), (2, "q2", "b", "SELECT 2 ORDER BY 1"), (3, "q3", "b", "SELECT 3")],
        "id int, question string, category string, sql string",
    )
    predictions = spark.createDataFrame(
        [(1, "m", "SELECT 1", None, None), (1, "m", "SELECT 1", None, None), (2, "m", "SELECT 2", None, None),
         (9, "m", "SELECT 9", None, None), (1, "n", None, None, None), (2, "n", "SELECT 2", None, None), (3, "n", "SELECT 3", None, None)],
        "id int, predictor string, sql string, error string, run_error string",
    )
    gold = spark.createDataFrame(
        [(1, 0, ["x", None]), (1, 1, ["x", None]), (1, 2, ["y", "z"]), (2, 0, ["a"]), (2, 1, ["b"])], "id int, pos bigint, cells array<string>"
    )
    predicted = spark.createDataFrame(
        [(1, "m", 5, ["y", "z"]), (1, "m", 6, ["x", None]), (1, "m", 7, ["x", None]), (2, "m", 0, ["a"]), (2, "m", 1, ["b"]),
         (1, "n", 0, ["x", None]), (1, "n", 1, ["x", None]), (1, "n", 2, ["y", "z"]), (2, "n", 0, ["b"]), (2, "n", 1, ["a"])],
        "id int, predictor string, pos bigint, cells array<string>",
    )
    rows = evaluate(examples, predictions, gold, predicted).collect()
    got = sorted((r.predictor, r.id, r.correct, r.exec_error) for r in rows)
    assert got == [
        ("m", 1, True, None), ("m", 2, True, None), ("m", 3, False, "predictor error: no prediction"),
        ("m", 9, False, "no example with this id"),
        ("n", 1, False, "rejected unsafe SQL: there is no statement"), ("n", 2, False, None), ("n", 3, True, None),
    ]
    assert evaluate(examples, predictions.limit(0), gold, predicted.limit(0)).count() == 0


def test_one_row_too_few_or_too_many_is_a_miss(spark):
    examples = spark.createDataFrame([(1, "q", "a", "SELECT 1")], "id int, question string, category string, sql string")
    predictions = spark.createDataFrame(
        [(1, p, "SELECT 1", None, None) for p in ("few", "many", "none", "same")],
        "id int, predictor string, sql string, error string, run_error string",
    )
    gold = spark.createDataFrame([(1, 0, ["x"]), (1, 1, ["y"])], "id int, pos bigint, cells array<string>")
    predicted = spark.createDataFrame(
        [(1, "few", 0, ["x"]), (1, "many", 0, ["x"]), (1, "many", 1, ["y"]), (1, "many", 2, ["y"]), (1, "same", 0, ["y"]), (1, "same", 1, ["x"])],
        "id int, predictor string, pos bigint, cells array<string>",
    )
    verdicts = {r.predictor: r.correct for r in evaluate(examples, predictions, gold, predicted).collect()}
    assert verdicts == {"few": False, "many": False, "none": False, "same": True}
