"""Null keys and statements, and broken input files."""

import pytest

from tallyframe.operators.reporting import first_rows
from tallyframe.operators.scoring import last_wins, screen_statements
from tallyframe.sources.examples import read_examples
from tallyframe.sources.reports import read_reports


def test_no_statement_is_refused(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "SELECT 1")], "id int, sql string")
    allowed = {r["id"]: (r["allowed"], r["reason"]) for r in screen_statements(df, "sql").collect()}
    assert [allowed[i][0] for i in (1, 2, 3)] == [False, False, True]
    assert allowed[1][1] == "there is no statement"


def test_last_wins_with_null_orders(spark):
    df = spark.createDataFrame(
        [("a", None, "x"), ("b", None, "y"), ("b", -1, "z"), ("c", 1, "v"), ("c", 2, None)], "k string, o int, v string"
    )
    assert {r["k"]: (r["o"], r["v"]) for r in last_wins(df, "k", "o").collect()} == {"a": (None, "x"), "b": (-1, "z"), "c": (2, None)}


def test_first_rows_of_the_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (None, 3), ("a", 1)], "g string, id int")
    rows = sorted(((r["g"] or "", r["id"], r["place"], r["total"], r["remaining"]) for r in first_rows(df, "g", ["id"], 2).collect()))
    assert rows == [("", 1, 1, 3, 1), ("", 2, 2, 3, 1), ("a", 1, 1, 1, 0)]


def test_broken_lines_are_errors(spark, tmp_path):
    path = tmp_path / "broken.jsonl"
    path.write_text('{"question": "q", "id": "1"}\n{"question": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_examples(spark, str(path)).collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        read_reports(spark, str(path), one_per_file=False).collect()
