"""Sums of row hashes against comparing the rows themselves."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tallyframe.operators import comparison as cmp
from tallyframe.operators import fingerprints as fp
from tallyframe.plans.evaluation import evaluate

ROWS = "example_id int, side string, pos bigint, cells array<string>"


def _results(seed, n=60):
    """Results of two sides with small changes, nulls and shifted cell borders."""
    rng = random.Random(seed)
    cells = [["n:1"], ["s:a", None], [None, "s:a"], ["s:a"], ["s:", "s:a"], ["s:ab", "s:c"], ["s:a", "s:bc"], [None], [None, None], []]
    rows = []
    for example in range(n):
        gold = [rng.choice(cells) for _ in range(rng.randrange(5))]
        pred = list(gold)
        change = rng.randrange(5)
        if change == 1:
            rng.shuffle(pred)
        elif change == 2 and pred:
            pred[rng.randrange(len(pred))] = rng.choice(cells)
        elif change == 3 and pred:
            pred.append(pred[0])
        elif change == 4 and pred:
            pred.pop()
        for side, result in (("gold", gold), ("pred", pred)):
            rows += [(example, side, i if rng.random() < 0.95 else None, c) for i, c in enumerate(result)]
    return rows


def test_same_verdicts_as_the_rows(spark):
    examples = spark.createDataFrame([(i, i % 2 == 0) for i in range(70)], "example_id int, ordered boolean")
    for seed in range(3):
        rows = _results(seed)
        results = spark.createDataFrame(rows, ROWS).repartition(4)
        for match in (cmp.match_unordered, cmp.match_ordered, cmp.match_results):
            fast, exact = (sorted(tuple(r) for r in match(examples, results, exact=e).collect()) for e in (False, True))
            assert fast == exact and len(fast) == 70
        plain = {i: Counter((s, tuple(c)) for e, s, _, c in rows if e == i) for i in range(70)}
        want = {i: all(n == plain[i][("pred" if s == "gold" else "gold", c)] for (s, c), n in plain[i].items()) for i in plain}
        assert {r[0]: r[2] for r in cmp.match_unordered(examples, results).collect()} == want


def test_parts_add_up_to_the_whole(spark):
    rows = spark.createDataFrame([(e, i, c) for e, _, i, c in _results(5)], "id int, pos bigint, cells array<string>")
    rows = rows.unionByName(rows.where("id < 9"))
    parts = fp.fingerprints(rows.where("pos < 2"), "id").unionByName(fp.fingerprints(rows.where("pos IS NULL OR pos >= 2"), "id"))
    whole = {r["id"]: r for r in fp.fingerprints(rows, "id").collect()}
    assert {r["id"]: r for r in fp.merged(parts, "id").collect()} == whole


def test_limbs_are_the_hashes(spark):
    row = spark.range(1).select(F.array(F.lit("s:x"), F.lit(None).cast("string")).alias("cells"), F.lit(3).cast("bigint").alias("pos"))
    hashes = fp.with_hashes(row).first()
    mark = fp.fingerprints(row).first()
    for part, names in (("as_set", ("_h0", "_h1")), ("as_list", ("_p0", "_p1"))):
        limbs = list(mark[part])
        assert limbs[0] == 1
        for k, name in enumerate(names):
            a, b, c = limbs[1 + 3 * k : 4 + 3 * k]
            assert a | b << 22 | c << 43 == hashes[name] % 2**64
    assert len({hashes[n] for n in ("_h0", "_h1", "_p0", "_p1")}) == 4


def test_same_result_by_a_column(spark):
    gold = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("b", 1, None), (None, 1, 1.0)], "k string, pos int, v double")
    pred = spark.createDataFrame([("a", 2, 2.001), ("a", 1, 2.0), ("b", 1, 0.0), (None, 1, 1.0), ("c", 1, 1.0)], "k string, pos int, v double")
    for exact in (False, True):
        got = {r["k"]: r["matched"] for r in cmp.same_result(gold, pred, "pos", "k", exact).collect()}
        assert got == {"a": True, "b": False, None: True, "c": False}


def test_whole_run_agrees_with_the_rows(spark):
    examples = spark.range(40).select(
        F.col("id"), F.lit("q").alias("question"), (F.col("id") % 3).cast("string").alias("category"),
        F.when(F.col("id") % 2 == 0, "SELECT 1 ORDER BY 1").otherwise("SELECT 1").alias("sql"),
    )
    names = F.explode(F.array(F.lit("m"), F.lit("n"))).alias("predictor")
    nothing = F.lit(None).cast("string")
    predictions = spark.range(44).where("id % 9 <> 4").select("id", names, F.lit("SELECT 1").alias("sql"), nothing.alias("error"), nothing.alias("run_error"))
    rows = spark.createDataFrame([(e, s, i, c) for e, s, i, c in _results(8, 40)], "id int, side string, pos bigint, cells array<string>")
    gold = rows.where("side = 'gold'").drop("side")
    predicted = rows.withColumn("predictor", F.when(F.col("side") == "gold", "m").otherwise("n")).drop("side")
    fast, exact = (
        sorted((r["id"], r["predictor"], r["correct"], r["exec_error"] or "") for r in evaluate(examples, predictions, gold, predicted, exact=e).collect())
        for e in (False, True)
    )
    assert fast == exact and len({r[2] for r in fast}) == 2
    assert evaluate(examples, predictions, gold, predicted).columns == evaluate(examples, predictions, gold, predicted, True).columns
