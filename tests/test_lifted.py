"""All parameters of a template in one plan against one run for each."""

import pytest
from pyspark.sql import functions as F

from test_shop import CASES, shop  # noqa: F401  (the fixture)
from tallyframe.operators.comparison import pack_cells
from tallyframe.plans import lifted
from tallyframe.plans import workload as w

# Template -> (single run, its values, one of them without rows).
SINGLE = {
    "q01": (w.q01_customers_in_country, ["UK", "Peru", "Nowhere"]),
    "q02": (w.q02_count_orders_with_status, ["shipped", "pending", "lost"]),
    "q03": (w.q03_products_of_category, ["Toys", "Books", "None"]),
    "q04": (w.q04_count_customers_of_tier, ["gold", "free", "tin"]),
    "q07": (w.q07_orders_of_status_per_customer, ["pending", "shipped", "lost"]),
    "q09": (w.q09_buyers_of_category, ["Books", "Home", "None"]),
    "q11": (w.q11_tickets_with_people, ["high", "low", "odd"]),
    "q14": (w.q14_top_products_by_price, [3, 5, 50]),
    "q15": (w.q15_top_spenders, ["delivered", "returned", "lost"]),
    "q16": (w.q16_customers_with_more_orders, [2, 5, 1000]),
    "q17": (w.q17_expensive_categories, [100.0, 150.0, 1e6]),
    "q23": (w.q23_bought_every_product, ["Toys", "Books", "None"]),
    "q24": (w.q24_orders_in_year, [2023, 2024, 1999]),
    "q25": (w.q25_recent_signups, ["2026-08-20", "2024-02-29", "2099-01-01"]),
    "q26": (w.q26_purchases_of_tier, ["silver", "gold", "tin"]),
    "q27": (w.q27_orders_of_status_with_zeros, ["pending", "shipped", "lost"]),
    "q28": (w.q28_count_in_where, [0, 5, 1000]),
}
ORDERED = {"q03", "q07", "q14", "q15", "q16", "q27", "q28"}


@pytest.mark.parametrize("template", list(SINGLE))
def test_all_values_in_one_plan(spark, shop, template):  # noqa: F811
    tables, _ = shop
    run, values = SINGLE[template]
    asked = spark.createDataFrame([(str(v),) for v in [*values, values[0]]], "value string")
    found = {}
    for r in lifted.gold_rows(tables, template, asked).collect():
        found.setdefault(r.value, []).append((r.pos, r.cells))
    some = 0
    for value in values:
        single = run(tables, value)
        want = [r.cells for r in single.select(pack_cells(single).alias("cells")).collect()]
        got = found.get(str(value), [])
        some += bool(want)
        if template in ORDERED:
            assert [c for _, c in sorted(got)] == want and sorted(p for p, _ in got) == list(range(len(want)))
        else:
            assert sorted(map(repr, (c for _, c in got))) == sorted(map(repr, want)) and {p for p, _ in got} <= {None}
    assert some >= 2


def test_templates_are_all_there():
    assert sorted([*lifted.LIFTED, *lifted.PLAIN]) == [f"q{i:02d}" for i in range(1, 29)] and set(CASES) == {*lifted.LIFTED, *lifted.PLAIN}


def test_template_without_a_parameter(spark, shop):  # noqa: F811
    tables, _ = shop
    gold = lifted.gold_rows(tables, "q13")
    examples = spark.createDataFrame([("a", None), ("b", None)], "id string, value string")
    assert sorted(tuple(r) for r in lifted.gold_of_examples(examples, gold).collect()) == [(i, None, [f"s:e{k}"]) for i in "ab" for k in (1, 2)]


def test_rows_of_examples_that_share_a_value(spark, shop):  # noqa: F811
    tables, _ = shop
    examples = spark.createDataFrame([("x", "gold"), ("y", "gold"), ("z", "tin")], "id string, value string")
    gold = lifted.gold_rows(tables, "q04", examples.select("value"))
    rows = {r.id: r.cells for r in lifted.gold_of_examples(examples, gold).collect()}
    n = tables["customers"].where(F.col("tier") == "gold").count()
    assert rows == {"x": [f"n:{100 * n}"], "y": [f"n:{100 * n}"], "z": ["n:0"]}
