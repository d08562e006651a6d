"""What Spark makes of the queries."""

import os
import re

import pytest

from oracle import DATA
from tallyframe.plans.catalog import CATALOG

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
WRITES_FIRST = ("d_build", "s02_s04", "s03_s05", "s05", "s06", "s07", "e_stored")


def _plan(spark, name):
    return CATALOG[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in CATALOG if not n.startswith(WRITES_FIRST)])
def test_no_python_and_no_product(spark, name):
    plan = _plan(spark, name)
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|PythonUDF", plan)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("name", ["q18_customers_without_orders", "q19_products_without_reviews",
                                  "q20_employees_without_tickets", "j08_not_exists"])
def test_anti_joins(spark, name):
    assert "LeftAnti" in _plan(spark, name)


@pytest.mark.parametrize("name", ["q14_top_products_by_price", "q15_top_spenders", "o04_row_cap"])
def test_top_k_without_a_full_sort(spark, name):
    assert "TakeOrderedAndProject" in _plan(spark, name)


def test_first_rows_are_cut_before_the_shuffle(spark):
    plan = _plan(spark, "e18_top_failures")
    assert re.search(r"WindowGroupLimit.*Partial", plan) and "WindowGroupLimit" in plan


@pytest.mark.parametrize("name, pushed", [
    ("q02_count_orders_with_status", "EqualTo(o_orderstatus,P)"),
    ("q24_orders_in_year", "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)"),
    ("q25_recent_signups", "GreaterThanOrEqual(o_orderdate,2001-02-01T00:00)"),
    ("q26_purchases_of_tier", "EqualTo(c_mktsegment,MACHINERY)"),
])
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed in _plan(spark, name)


def test_columns_are_pruned(spark):
    plan = _plan(spark, "q15_top_spenders")
    assert "struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double>" in plan
    assert "p_name" not in _plan(spark, "q09_buyers_of_category")


def test_only_counts_meet_in_one_task(spark):
    """Where a plan has a single-partition exchange below a window, it carries
    piece counts, never the rows."""
    for name in ("d06_seeded_shuffle", "d07_assign_ids", "d12_assign_batches"):
        lines = _plan(spark, name).splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert re.search(r"functions=\[(partial_)?count\(1\)\]", lines[i + 1])


def test_counts_and_their_mean_share_a_shuffle(spark):
    df = CATALOG["q22_customers_above_average_orders"](spark, FOLDER)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or "Reused" in plan


@pytest.mark.parametrize("name", ["e10_latency_stats", "e10_latency_stats_overall", "e14_report"])
def test_order_statistics_read_the_rows_twice(spark, name):
    df = CATALOG[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 2 and "ReusedExchange" in final


def test_shuffled_order_deals_the_rows_once(spark):
    plan = _plan(spark, "d06_seeded_shuffle")
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning(_piece" not in plan.split("BroadcastExchange")[0]


def _formatted(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", ["e04_match_unordered", "e04_same_result", "e05_match_ordered", "e06_match_by_statement",
                                  "e_evaluate_run", "f17_cells_equal_across_types"])
def test_no_result_row_is_shuffled(spark, name):
    """Only sums of hashes cross an exchange."""
    df = CATALOG[name](spark, FOLDER)
    exchanges = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", _formatted(spark, df))
    assert exchanges and not any(re.search(r"cells#|_h\d#|_p\d#|l_extendedprice|o_totalprice", x) for x in exchanges)


def test_a_split_neither_ranks_nor_shuffles_the_rows(spark):
    df = CATALOG["d05_stratified_split"](spark, FOLDER)
    text = _formatted(spark, df)
    assert not re.search(r"\) Window\b|SortMergeJoin", text)
    top = text[:text.index("Exchange")]
    assert "BroadcastHashJoin" in top  # nothing but the limits lies below an exchange


def test_all_constraints_read_each_table_once(spark):
    df = CATALOG["c_check_tables"](spark, FOLDER)
    text = _formatted(spark, df)
    assert len(re.findall(r"\) Scan parquet", text)) == 11
    assert len(re.findall(r"\) Exchange", text)) == 3  # marks, keys, one row of sums


@pytest.mark.parametrize("name", ["q23_bought_every_product", "q23_bought_every_brand", "j09_flags_with_every_part"])
def test_division_shuffles_bitmaps_not_pairs(spark, name):
    text = _formatted(spark, CATALOG[name](spark, FOLDER))
    assert "partial_bit_or" in text
    merged = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\(\w+#\d+L?, word", text)
    assert merged and all("bit" in x for x in merged)
    assert not re.search(r"count\(distinct", text)
