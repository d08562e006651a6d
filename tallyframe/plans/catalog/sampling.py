"""Sampling and expansion on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import sampling as s
from tallyframe.plans.catalog.registry import query, sql_hash, sql_unit


@query("g01_weighted_assign", f"""
    SELECT c_custkey, CASE WHEN u < 0.625 THEN 'low' WHEN u < 0.875 THEN 'mid' ELSE 'high' END AS level
    FROM (SELECT c_custkey, {sql_unit(42, 'c_custkey')} AS u FROM customer)""")
def _g01(t):
    keys = t["customer"].select("c_custkey")
    return s.weighted_assign(keys, "c_custkey", ["low", "mid", "high"], [5, 2, 1], 42, "level")


@query("g02_bernoulli", f"""
    SELECT * FROM orders WHERE {sql_unit(42, 'o_orderkey')} < 0.35""")
def _g02(t):
    return s.bernoulli(t["orders"], "o_orderkey", 0.35, 42)


@query("g03_one_per_group", f"""
    SELECT o_custkey, o_orderkey, o_totalprice FROM (
        SELECT *, row_number() OVER (
            PARTITION BY o_custkey ORDER BY {sql_hash(42, 'o_orderkey')}, o_orderkey) AS rn
        FROM orders) WHERE rn = 1""")
def _g03(t):
    orders = t["orders"].select("o_custkey", "o_orderkey", "o_totalprice")
    return s.one_per_group(orders, "o_custkey", "o_orderkey", 42)


@query("g04_expand", """
    SELECT p_partkey, n FROM part, range(1, 51) r(n) WHERE n <= p_size - 5""")
def _g04(t):
    parts = t["part"].select("p_partkey", (F.col("p_size") - 5).alias("copies"))
    return s.expand(parts, "copies").select("p_partkey", "n")


@query("g05_date_between", f"""
    SELECT l_orderkey, o_orderkey, o_orderdate::date + cast(floor({sql_unit(42, 'o_orderkey')} * (
        greatest(date_diff('day', o_orderdate::date, last_day), 0) + 1)) AS integer) AS drawn
    FROM orders JOIN (SELECT l_orderkey, max(l_shipdate)::date AS last_day
                      FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def _g05(t):
    last = t["lineitem"].groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_day"))
    spans = t["orders"].join(last, F.col("l_orderkey") == F.col("o_orderkey"))
    drawn = s.date_between(spans, "o_orderkey", "o_orderdate", "last_day", 42, "drawn")
    return drawn.select("l_orderkey", "o_orderkey", "drawn")
