"""Known verdicts for single changes of a result."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import comparison as cmp

SCHEMA = "pos bigint, a bigint, b double, c string"
GOLD = [(0, 1, 2.5, "x"), (1, 1, 2.5, "x"), (2, 2, 0.0, None), (3, 3, 7.0, "y")]


def _verdict(spark, gold, pred, order_by=None, schema=SCHEMA, pred_schema=None):
    g = spark.createDataFrame(gold, schema)
    p = spark.createDataFrame(pred, pred_schema or schema)
    if order_by is None:
        g, p = g.drop("pos"), p.drop("pos")
    return cmp.same_result(g, p, order_by).first().matched


def _with(i, row):
    return [*GOLD[:i], row, *GOLD[i + 1:]]


CASES = {
    "equal": (GOLD, True, True),
    "permuted": ([(p, *r[1:]) for p, r in zip((3, 2, 1, 0), GOLD)], True, False),
    "row missing": (GOLD[:3], False, False),
    "row doubled": ([*GOLD, (4, 3, 7.0, "y")], False, False),
    "one of two copies lost": (GOLD[1:], False, False),
    "cell below rounding": (_with(3, (3, 3, 7.001, "y")), True, True),
    "cell above rounding": (_with(3, (3, 3, 7.01, "y")), False, False),
    "minus zero": (_with(2, (2, 2, -0.0, None)), True, True),
    "null became text": (_with(2, (2, 2, 0.0, "")), False, False),
    "other text": (_with(3, (3, 3, 7.0, "Y")), False, False),
}


def test_single_changes(spark):
    """All cases as one batch: an example per case."""

    def side(name, picked):
        rows = [(case, *row) for case in CASES for row in picked(case)]
        df = spark.createDataFrame(rows, f"case string, {SCHEMA}")
        return cmp.result_rows(df, "case", name, ["a", "b", "c"], "pos")

    results = side("gold", lambda case: GOLD).unionByName(side("pred", lambda case: CASES[case][0]))
    examples = spark.createDataFrame([(c,) for c in CASES], "example_id string")
    as_set = {r.example_id: r.matched for r in cmp.match_unordered(examples, results).collect()}
    as_list = {r.example_id: r.matched for r in cmp.match_ordered(examples, results).collect()}
    assert as_set == {c: v[1] for c, v in CASES.items()}
    assert as_list == {c: v[2] for c, v in CASES.items()}


@pytest.mark.parametrize("case", ["equal", "permuted", "row doubled"])
def test_pair(spark, case):
    pred, as_set, as_list = CASES[case]
    assert _verdict(spark, GOLD, pred) is as_set
    assert _verdict(spark, GOLD, pred, "pos") is as_list


def test_types_and_names_do_not_matter(spark):
    pred = [(r[0], None if r[1] is None else float(r[1]), r[2], r[3]) for r in GOLD]
    assert _verdict(spark, GOLD, pred, pred_schema="pos bigint, q double, r double, s string")


def test_column_order_and_count_matter(spark):
    swapped = [(r[0], r[2], r[1], r[3]) for r in GOLD]
    assert not _verdict(spark, GOLD, swapped, pred_schema="pos bigint, b double, a bigint, c string")
    fewer = [r[:3] for r in GOLD]
    assert not _verdict(spark, GOLD, fewer, pred_schema="pos bigint, a bigint, b double")


def test_number_is_not_text(spark):
    assert not _verdict(spark, [(0, 5)], [(0, "5")], schema="pos bigint, a bigint",
                        pred_schema="pos bigint, a string")


def test_empty_results_match_whatever_their_columns(spark):
    assert _verdict(spark, [], [], pred_schema="pos bigint, z string")


def test_large_and_rounded_numbers(spark):
    cases = [
        (2**53, float(2**53), True), (2**62, float(2**62), True), (2**53 + 1, float(2**53), False),
        (10**17, 1e17, True), (-(10**17), -1e17, True), (2**60 + 1, float(2**60), False),
        (7, 7.004, True), (7, 7.006, False), (0, -0.0, True), (5, None, False),
    ]
    gold = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, a bigint")
    pred = spark.createDataFrame([(i, c[1]) for i, c in enumerate(cases)], "i int, x double")
    results = cmp.result_rows(gold, "i", "gold", ["a"]).unionByName(
        cmp.result_rows(pred, "i", "pred", ["x"])
    )
    examples = gold.select(F.col("i").alias("example_id"))
    got = {r.example_id: r.matched for r in cmp.match_unordered(examples, results).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_normalize_rounds_to_cents(spark):
    values = {0.125: 0.12, 0.375: 0.38, -0.125: -0.12, 1.005: 1.0, -1.239: -1.24, 1e300: 1e300,
              7.0: 7.0, 12345678.909: 12345678.91}
    df = spark.createDataFrame([(v, 3, "t") for v in values], "a double, b int, c string")
    got = [tuple(r) for r in cmp.normalize_rows(df).collect()]
    assert got == [(want, 3, "t") for want in values.values()]


def _long(spark, rows):
    return spark.createDataFrame(
        rows, "example_id string, side string, pos bigint, cells array<string>"
    )


def test_batch_of_mixed_examples(spark):
    examples = spark.createDataFrame(
        [("set", False), ("list", True), ("same", True), ("empty", True), ("lost", False)],
        "example_id string, ordered boolean",
    )
    rows = []
    for example, pred in {"set": [2, 1], "list": [2, 1], "same": [1, 2], "lost": [1]}.items():
        rows += [(example, "gold", i, [f"n:{v}"]) for i, v in enumerate([1, 2])]
        rows += [(example, "pred", i, [f"n:{v}"]) for i, v in enumerate(pred)]
    results = _long(spark, rows)

    def verdicts(df):
        return {r.example_id: r.matched for r in df.collect()}

    assert verdicts(cmp.match_results(examples, results)) == {
        "set": True, "list": False, "same": True, "empty": True, "lost": False
    }
    assert verdicts(cmp.match_unordered(examples, results))["list"]
    assert not verdicts(cmp.match_ordered(examples, results))["set"]


def test_every_result_matches_itself(spark):
    orders = spark.range(2000).select(
        (F.col("id") % 37).alias("e"), F.col("id").alias("pos"), (F.col("id") / 7).alias("v")
    )
    both = cmp.result_rows(orders, "e", "gold", ["v"], "pos").unionByName(
        cmp.result_rows(orders, "e", "pred", ["v"], "pos")
    )
    examples = orders.select(F.col("e").alias("example_id")).distinct()
    assert cmp.match_ordered(examples, both).where(~F.col("matched")).count() == 0
    wrong = orders.withColumn("v", F.lit(0.0))
    both = cmp.result_rows(orders, "e", "gold", ["v"], "pos").unionByName(
        cmp.result_rows(wrong, "e", "pred", ["v"], "pos")
    )
    assert cmp.match_unordered(examples, both).where("matched").count() == 0


def test_decimals_keep_their_digits_and_wide_numbers_agree(spark):
    from pyspark.sql import types as T

    from tallyframe.functions.values import cell_text, round_cell

    def text(value, dtype):
        return spark.range(1).select(cell_text(F.expr(f"CAST({value} AS {dtype.simpleString()})"), dtype)).first()[0]

    wide = T.DecimalType(22, 2)
    assert text("'12345678901234567890.12'", wide) != text("'12345678901234567890.98'", wide)
    for dtype in (T.DecimalType(5, 0), T.DecimalType(6, 1), T.DecimalType(9, 4), T.LongType(), T.DoubleType()):
        assert text("'5'", dtype) == "n:500"
        assert text("'0'", dtype) == "n:0"
        assert text("'-7'", dtype) == "n:-700"
    assert text("'-0.05'", T.DecimalType(9, 4)) == text("'-0.05'", T.DoubleType()) == "n:-5"
    assert text("'9223372036854773760'", T.LongType()) == text("'9223372036854773760'", T.DoubleType())
    rounded = spark.range(1).select(round_cell(F.expr("CAST('0.125' AS decimal(9,4))"), T.DecimalType(9, 4))).first()[0]
    assert str(rounded) == "0.12"
