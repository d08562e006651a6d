"""Expected rows of the workload's templates for all their parameters at once.

A template that is run for each of its parameter values reads the tables as
often as there are values. Here the values are a table: each template is one
plan that joins or groups by the parameter's column and gives the rows of every
value, (value, pos, cells). ``pos`` is null where the template asks for no order.
Values without any row have none, but for counts, which are 0.

Conditions that are no equality (more than n orders, above a price, since a
date) look each row up in the list of the template's values, so a row is copied
only for the values whose result it is part of.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.comparison import pack_cells
from tallyframe.operators.ordinals import with_integer_form
from tallyframe.operators.positions import ordered_positions
from tallyframe.plans import workload as w

Shop = Mapping[str, DataFrame]
_FINE = 1 << 16  # keys in one piece of an order


def _listed(values: DataFrame) -> Column:
    """All values in one array: a template has a few of them."""
    return F.coalesce(values.agg(F.collect_set("value")).scalar(), F.array().cast("array<string>"))


def _each(rows: DataFrame, values: DataFrame, condition: Callable[[Column], Column]) -> DataFrame:
    """A row for each value that fulfils the condition."""
    listed = rows.withColumn("_values", _listed(values))
    return listed.withColumn("value", F.explode(F.filter("_values", condition))).drop("_values")


def _only(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.col(column).cast("string")).join(values, "value", "left_semi")


def _numbers(values: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """A count for every value."""
    return values.join(counts, "value", "left").select("value", F.coalesce(name, F.lit(0)).alias(name))


def _in_order(rows: DataFrame, order: list[Column], cut: list[Column], shown: list[str]) -> DataFrame:
    return ordered_positions(rows, "value", order, cut).select("value", "pos", *shown)


def _q02(shop: Shop, values: DataFrame) -> DataFrame:
    counts = shop["orders"].groupBy(F.col("status").alias("value")).agg(F.count("*").alias("order_count"))
    return _numbers(values, counts, "order_count")


def _q03(shop: Shop, values: DataFrame) -> DataFrame:
    rows = with_integer_form(_only(shop["products"], "category", values), "price", "_price")
    return _in_order(rows, [F.col("price"), F.col("product_id")], [F.shiftright("_price", 40), F.lit(0)], ["name", "price"])


def _q04(shop: Shop, values: DataFrame) -> DataFrame:
    counts = shop["customers"].groupBy(F.col("tier").alias("value")).agg(F.count("*").alias("customer_count"))
    return _numbers(values, counts, "customer_count")


def _by_count(rows: DataFrame) -> DataFrame:
    return _in_order(rows, [F.desc("order_count"), F.col("customer_id")], [-F.col("order_count"), F.floor(F.col("customer_id") / _FINE)],
                     ["name", "order_count"])


def _names(shop: Shop) -> DataFrame:
    return shop["customers"].select("customer_id", "name")


def _q07(shop: Shop, values: DataFrame) -> DataFrame:
    counts = _only(shop["orders"], "status", values).groupBy("value", "customer_id").agg(F.count("*").alias("order_count"))
    return _by_count(counts.join(_names(shop), "customer_id"))


def _bought(shop: Shop, values: DataFrame, *more: str) -> DataFrame:
    """Distinct (value, customer_id, more) of purchases from the named categories."""
    products = _only(shop["products"], "category", values).select("value", "product_id")
    items = shop["order_items"].select("order_id", "product_id").join(products, "product_id").select("value", "order_id", *more).distinct()
    return items.join(shop["orders"].select("order_id", "customer_id"), "order_id").select("value", "customer_id", *more).distinct()


def _q09(shop: Shop, values: DataFrame) -> DataFrame:
    return _bought(shop, values).join(_names(shop), "customer_id").select("value", "name").distinct()


def _q11(shop: Shop, values: DataFrame) -> DataFrame:
    tickets = _only(shop["support_tickets"], "priority", values).select("value", "ticket_id", "customer_id", "assigned_employee_id")
    customers = shop["customers"].select("customer_id", F.col("name").alias("customer_name"))
    employees = shop["employees"].select(F.col("employee_id").alias("assigned_employee_id"), F.col("name").alias("employee_name"))
    joined = tickets.join(customers, "customer_id").join(employees, "assigned_employee_id", "left")
    return joined.select("value", "ticket_id", "customer_name", "employee_name")


def _q14(shop: Shop, values: DataFrame) -> DataFrame:
    """The largest n alone bounds what is sorted; one job looks it up."""
    most = values.agg(F.max(F.col("value").cast("int"))).first()[0] or 0
    top = shop["products"].orderBy(F.desc("price"), "product_id").limit(most)
    places = Window.orderBy(F.desc("price"), "product_id")
    ranked = top.withColumn("pos", F.row_number().over(places).cast("bigint") - 1)
    wanted = values.where("cast(value AS bigint) > 0").select("value", F.explode(F.expr("sequence(0L, cast(value AS bigint) - 1)")).alias("pos"))
    return wanted.join(ranked, "pos").select("value", "pos", "name", "price")


def _q15(shop: Shop, values: DataFrame, n: int = 5) -> DataFrame:
    per_order = shop["order_items"].groupBy("order_id").agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("amount"))
    orders = _only(shop["orders"], "status", values).select("value", "order_id", "customer_id")
    spent = orders.join(per_order, "order_id").groupBy("value", "customer_id").agg(F.round(F.sum("amount"), 2).alias("total_spent"))
    named = spent.join(_names(shop), "customer_id")
    place = F.row_number().over(Window.partitionBy("value").orderBy(F.desc("total_spent"), "customer_id"))
    top = named.withColumn("place", place).where(F.col("place") <= n)  # cut in each map task
    return top.select("value", (F.col("place") - 1).cast("bigint").alias("pos"), "name", "total_spent")


def _orders_per_customer(shop: Shop) -> DataFrame:
    return shop["orders"].groupBy("customer_id").agg(F.count("*").alias("order_count"))


def _q16(shop: Shop, values: DataFrame) -> DataFrame:
    busy = _each(_orders_per_customer(shop), values, lambda v: F.col("order_count") > v.cast("bigint"))
    return _by_count(busy.join(_names(shop), "customer_id"))


def _q17(shop: Shop, values: DataFrame) -> DataFrame:
    averages = shop["products"].groupBy("category").agg(F.avg("price").alias("average"))
    above = _each(averages, values, lambda v: F.col("average") > v.cast("double"))
    return above.select("value", "category", F.round("average", 2).alias("avg_price"))


def _q23(shop: Shop, values: DataFrame) -> DataFrame:
    """A category without products asks for nothing: all customers have it."""
    needed = _only(shop["products"], "category", values).groupBy("value").agg(F.countDistinct("product_id").alias("needed"))
    covered = _bought(shop, values, "product_id").groupBy("value", "customer_id").agg(F.count("*").alias("covered"))
    full = covered.join(needed, "value").where("covered = needed").join(_names(shop), "customer_id").select("value", "name")
    nothing = values.join(needed, "value", "left_anti")
    return full.unionByName(_each(_names(shop), nothing, lambda v: F.lit(True)).select("value", "name"))


def _q24(shop: Shop, values: DataFrame) -> DataFrame:
    counts = shop["orders"].groupBy(F.year("order_date").cast("string").alias("value")).agg(F.count("*").alias("order_count"))
    return _numbers(values, counts, "order_count")


def _q25(shop: Shop, values: DataFrame, months: int = 6) -> DataFrame:
    since = _each(shop["customers"], values, lambda v: F.col("signup_date") >= F.add_months(v.cast("date"), -months))
    return since.select("value", "name", "signup_date")


def _q26(shop: Shop, values: DataFrame) -> DataFrame:
    customers = _only(shop["customers"], "tier", values).select("value", "customer_id", F.col("name").alias("customer_name"))
    products = shop["products"].select("product_id", F.col("name").alias("product_name"))
    orders = shop["orders"].select("order_id", "customer_id").join(customers, "customer_id")
    items = shop["order_items"].select("order_id", "product_id", "quantity")
    return items.join(orders, "order_id").join(products, "product_id").select("value", "order_id", "customer_name", "product_name", "quantity")


def _q27(shop: Shop, values: DataFrame) -> DataFrame:
    counts = _only(shop["orders"], "status", values).groupBy("value", "customer_id").agg(F.count("*").alias("n"))
    everyone = _each(_names(shop), values, lambda v: F.lit(True)).join(counts, ["value", "customer_id"], "left")
    rows = everyone.withColumn("order_count", F.coalesce("n", F.lit(0)))
    return _in_order(rows, [F.col("customer_id")], [F.floor(F.col("customer_id") / _FINE)], ["name", "order_count"])


def _q28(shop: Shop, values: DataFrame) -> DataFrame:
    counted = _names(shop).join(_orders_per_customer(shop), "customer_id", "left")
    busy = _each(counted, values, lambda v: F.coalesce("order_count", F.lit(0)) > v.cast("bigint"))
    return _in_order(busy, [F.col("name"), F.col("customer_id")], [F.substring("name", 1, 12)], ["name"])


# Templates with a parameter; the others are the workload's own functions.
LIFTED: dict[str, Callable[[Shop, DataFrame], DataFrame]] = {
    "q01": lambda shop, values: _only(shop["customers"], "country", values).select("value", "name"),
    "q02": _q02, "q03": _q03, "q04": _q04, "q07": _q07, "q09": _q09, "q11": _q11, "q14": _q14, "q15": _q15, "q16": _q16,
    "q17": _q17, "q23": _q23, "q24": _q24, "q25": _q25, "q26": _q26, "q27": _q27, "q28": _q28,
}
PLAIN: dict[str, Callable[[Shop], DataFrame]] = {
    name[:3]: getattr(w, name) for name in dir(w) if name[:1] == "q" and name[1:3].isdigit() and name[:3] not in LIFTED
}


def gold_rows(shop: Shop, template: str, values: DataFrame | None = None) -> DataFrame:
    """(value, pos, cells) of a template: for all of ``values`` (value, as text,
    repeated ones once), or with a null value and no positions for a template
    without parameter."""
    if template in LIFTED:
        rows = LIFTED[template](shop, values.select(F.col("value").cast("string").alias("value")).distinct())
    else:
        rows = PLAIN[template](shop).withColumn("value", F.lit(None).cast("string"))
    shown = [c for c in rows.columns if c not in ("value", "pos")]
    pos = F.col("pos") if "pos" in rows.columns else F.lit(None).cast("bigint")
    return rows.select("value", pos.cast("bigint").alias("pos"), pack_cells(rows, shown).alias("cells"))


def gold_of_examples(examples: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, pos, cells) for ``examples`` (id, value) of one template: phrasings that
    share a value share its rows."""
    keyed = examples.select("id", F.coalesce("value", F.lit("")).alias("_value"))
    return gold.withColumn("_value", F.coalesce("value", F.lit(""))).join(keyed, "_value").select("id", "pos", "cells")
