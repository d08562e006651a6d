"""The sortable form of doubles, and values at an index against a plain sort."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import ordinals as o
from tallyframe.operators import scoring as sc


def test_integer_form_is_the_bits(spark):
    rng = random.Random(1)
    values = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(5000)]
    values += [0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 2.225073858507201e-308, 1.7976931348623157e308]
    for e in range(-1074, 1024):
        x = math.ldexp(1.0, e)
        values += [x, -x, math.nextafter(x, 0), math.nextafter(x, math.inf)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for v, k in o.with_integer_form(df, "v", "k").collect():
        if v is None:
            assert k is None
        elif math.isnan(v):
            assert k == 2047 * 2**52 + 1
        else:
            bits = struct.unpack("<Q", struct.pack("<d", abs(v)))[0]
            assert k == (-bits if v < 0 else bits)


@pytest.mark.parametrize("most_large", [50_000, 3])
def test_values_at_an_index(spark, monkeypatch, most_large):
    """Large and small groups, a null group, one value many times, nulls."""
    monkeypatch.setattr(o, "_MOST_LARGE", most_large)
    rng = random.Random(2)

    def value():
        return None if rng.random() < 0.1 else rng.choice([1.5, 1.5, -2.25, rng.gauss(0, 100), rng.expovariate(1e-3)])

    rows = [(g, h, value()) for g in ("a", None) for h in (1, 2) for _ in range(700)] + [("solo", 1, 3.0), ("none", 1, None)]
    rows += [("same", 1, 7.0)] * 900 + [("few", 2, float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(5)
    picks = {"p50": o.upper_median, "p95": o.high_index(0.95), "low": lambda n: F.lit(0), "top": lambda n: n - 1}
    got = {(r.g, r.h): (r.n, r.p50, r.p95, r.low, r.top) for r in o.values_at(df, ["g", "h"], "v", picks).collect()}
    want = {}
    for g, h in {r[:2] for r in rows}:
        s = sorted(v for a, b, v in rows if (a, b) == (g, h) and v is not None)
        if s:
            want[g, h] = (len(s), s[len(s) // 2], s[min(len(s) - 1, int(0.95 * len(s)))], s[0], s[-1])
    assert got == want
    assert o.values_at(df.where("false"), ["g"], "v", picks).count() == 0


def test_null_predictor(spark):
    rows = [(None, "c", 20.0, True), (None, "c", 10.0, False), (None, None, 30.0, False), ("m", "c", None, True)]
    scored = spark.createDataFrame(rows, "predictor string, category string, latency_ms double, correct boolean").withColumn("cost_usd", F.lit(0.5))
    stats = {r.predictor: (r.p50, r.p95, r["mean"]) for r in sc.latency_stats(scored, ("predictor",)).collect()}
    assert stats == {None: (20.0, 30.0, 20.0), "m": (None, None, None)}
    listed = spark.createDataFrame([(None,), ("m",), ("idle",)], "predictor string")
    reports = {r.predictor: r for r in sc.report(scored.where("category IS NOT NULL"), listed).collect()}
    assert tuple(reports[None].latency_ms) == (20.0, 20.0, 15.0) and reports[None].accuracy == 0.5 and reports[None].n == 2
    assert tuple(reports["m"].latency_ms) == (0.0, 0.0, 0.0) and reports["m"].total_cost_usd == 0.5
    assert reports["idle"].n == 0 and reports["idle"].total_cost_usd is None and reports["idle"].accuracy_by_category == {}
    everyone = sc.latency_stats(scored).first()
    assert (everyone.p50, everyone.p95, everyone["mean"]) == (20.0, 30.0, 20.0)
    assert tuple(sc.latency_stats(scored.where("false")).first()) == (0.0, 0.0, 0.0)
