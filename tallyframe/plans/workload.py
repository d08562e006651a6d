"""The analytic workload: 28 parameterised queries over the shop tables.

Each takes the tables by name and returns a lazy DataFrame. Conventions:

* a fact table is filtered and summed up per key before it meets a table that
  only adds names, so a customer or product with a third of all rows shrinks to
  one row per map task before the shuffle;
* the right side of a semi or anti join is made distinct first, since there a
  hot key cannot be split;
* joins carry no size hints; Spark broadcasts a side when its size is known to
  be below the threshold and re-plans at run time;
* every ordering ends in a key, so ties come out the same each time.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.values import in_year, like_column
from tallyframe.operators.division import bitmaps, holders, numbered
from tallyframe.sources.tables import run

Shop = Mapping[str, DataFrame]


def _amount() -> Column:
    return F.col("quantity") * F.col("unit_price")


def _orders_per_customer(orders: DataFrame, counted: str = "*") -> DataFrame:
    return orders.groupBy("customer_id").agg(F.count(counted).alias("order_count"))


def _names(shop: Shop, *more: str) -> DataFrame:
    return shop["customers"].select("customer_id", "name", *more)


# ---- filters ----

def q01_customers_in_country(shop: Shop, country: str) -> DataFrame:
    return shop["customers"].where(F.col("country") == country).select("name")


def q02_count_orders_with_status(shop: Shop, status: str) -> DataFrame:
    return shop["orders"].where(F.col("status") == status).agg(F.count("*").alias("order_count"))


def q03_products_of_category(shop: Shop, category: str) -> DataFrame:
    chosen = shop["products"].where(F.col("category") == category)
    return chosen.orderBy("price", "product_id").select("name", "price")


# ---- aggregation ----

def q04_count_customers_of_tier(shop: Shop, tier: str) -> DataFrame:
    return shop["customers"].where(F.col("tier") == tier).agg(F.count("*").alias("customer_count"))


def q05_average_price_per_category(shop: Shop) -> DataFrame:
    average = F.round(F.avg("price"), 2).alias("avg_price")
    return shop["products"].groupBy("category").agg(average).orderBy("category")


def q06_total_revenue(shop: Shop) -> DataFrame:
    return shop["order_items"].agg(F.round(F.sum(_amount()), 2).alias("revenue"))


def q07_orders_of_status_per_customer(shop: Shop, status: str) -> DataFrame:
    counts = _orders_per_customer(shop["orders"].where(F.col("status") == status))
    named = counts.join(_names(shop), "customer_id")
    return named.orderBy(F.desc("order_count"), "customer_id").select("name", "order_count")


# ---- joins ----

def q08_orders_with_customer(shop: Shop) -> DataFrame:
    customers = _names(shop, "country")
    return shop["orders"].join(customers, "customer_id").select("order_id", "name", "country")


def q09_buyers_of_category(shop: Shop, category: str) -> DataFrame:
    """Distinct names, so namesakes merge. Only existence counts: semi joins
    keep the line items from multiplying orders or customers."""
    products = shop["products"].where(F.col("category") == category).select("product_id")
    items = shop["order_items"].join(products, "product_id", "left_semi")
    orders = shop["orders"].join(items.select("order_id").distinct(), "order_id", "left_semi")
    buyers = orders.select("customer_id").distinct()
    return _names(shop).join(buyers, "customer_id", "left_semi").select("name").distinct()


def q10_average_rating_per_product(shop: Shop) -> DataFrame:
    ratings = shop["reviews"].groupBy("product_id").agg(
        F.round(F.avg("rating"), 2).alias("avg_rating")
    )
    named = ratings.join(shop["products"].select("product_id", "name"), "product_id")
    return named.orderBy(F.desc("avg_rating"), "product_id").select("name", "avg_rating")


def q11_tickets_with_people(shop: Shop, priority: str) -> DataFrame:
    tickets = shop["support_tickets"].where(F.col("priority") == priority)
    tickets = tickets.select("ticket_id", "customer_id", "assigned_employee_id")
    customers = shop["customers"].select("customer_id", F.col("name").alias("customer_name"))
    employees = shop["employees"].select(
        F.col("employee_id").alias("assigned_employee_id"), F.col("name").alias("employee_name")
    )
    return (
        tickets.join(customers, "customer_id")
        .join(employees, "assigned_employee_id", "left")
        .select("ticket_id", "customer_name", "employee_name")
    )


def q12_employees_with_manager(shop: Shop) -> DataFrame:
    employees = shop["employees"].select("manager_id", F.col("name").alias("employee_name"))
    managers = shop["employees"].select(
        F.col("employee_id").alias("manager_id"), F.col("name").alias("manager_name")
    )
    return employees.join(managers, "manager_id", "left").select("employee_name", "manager_name")


def q13_top_of_hierarchy(shop: Shop) -> DataFrame:
    return shop["employees"].where(F.col("manager_id").isNull()).select("name")


# ---- top n ----

def q14_top_products_by_price(shop: Shop, n: int) -> DataFrame:
    ranked = shop["products"].orderBy(F.desc("price"), "product_id").limit(n)
    return ranked.select("name", "price")


def q15_top_spenders(shop: Shop, status: str, n: int = 5) -> DataFrame:
    """Line items are summed per order, then per customer, then named."""
    per_order = shop["order_items"].groupBy("order_id").agg(F.sum(_amount()).alias("amount"))
    orders = shop["orders"].where(F.col("status") == status).select("order_id", "customer_id")
    spent = orders.join(per_order, "order_id").groupBy("customer_id").agg(
        F.round(F.sum("amount"), 2).alias("total_spent")
    )
    named = spent.join(_names(shop), "customer_id")
    top = named.orderBy(F.desc("total_spent"), "customer_id").limit(n)
    return top.select("name", "total_spent")


# ---- having ----

def q16_customers_with_more_orders(shop: Shop, n: int) -> DataFrame:
    counts = _orders_per_customer(shop["orders"]).where(F.col("order_count") > n)
    named = counts.join(_names(shop), "customer_id")
    return named.orderBy(F.desc("order_count"), "customer_id").select("name", "order_count")


def q17_expensive_categories(shop: Shop, price: float) -> DataFrame:
    """The threshold applies to the average before rounding."""
    averages = shop["products"].groupBy("category").agg(F.avg("price").alias("average"))
    above = averages.where(F.col("average") > price)
    return above.select("category", F.round("average", 2).alias("avg_price"))


# ---- negation ----

def q18_customers_without_orders(shop: Shop) -> DataFrame:
    keys = shop["orders"].select("customer_id").distinct()
    return _names(shop).join(keys, "customer_id", "left_anti").select("name")


def q19_products_without_reviews(shop: Shop) -> DataFrame:
    products = shop["products"].select("product_id", "name")
    reviewed = shop["reviews"].select("product_id").distinct()
    return products.join(reviewed, "product_id", "left_anti").select("name")


def q20_employees_without_tickets(shop: Shop) -> DataFrame:
    """A ticket without an assignee excludes nobody."""
    assigned = shop["support_tickets"].select(
        F.col("assigned_employee_id").alias("employee_id")
    ).distinct()
    employees = shop["employees"].select("employee_id", "name")
    return employees.join(assigned, "employee_id", "left_anti").select("name")


# ---- subqueries ----

def q21_products_above_average(shop: Shop) -> DataFrame:
    average = shop["products"].agg(F.avg("price")).scalar()
    return shop["products"].where(F.col("price") > average).select("name", "price")


def q22_customers_above_average_orders(shop: Shop) -> DataFrame:
    """The average is over customers that have orders. The join would infer
    that the key is not null; said up front, it holds for both readers of the
    counts, and they share one shuffle."""
    known = shop["orders"].where(F.col("customer_id").isNotNull())
    counts = _orders_per_customer(known, "order_id")
    average = counts.agg(F.avg("order_count")).scalar()
    busy = counts.where(F.col("order_count") > average)
    return busy.join(_names(shop), "customer_id").select("name", "order_count")


def q23_bought_every_product(shop: Shop, category: str) -> DataFrame:
    products = numbered(shop["products"].where(F.col("category") == category), "product_id")
    items = shop["order_items"].select("order_id", "product_id").join(products, "product_id")
    orders = shop["orders"].select("order_id", "customer_id")
    bought = bitmaps(items.join(orders, "order_id"), "customer_id")
    return holders(_names(shop), bought, products, "customer_id").select("name")


# ---- dates ----

def q24_orders_in_year(shop: Shop, year: int) -> DataFrame:
    orders = shop["orders"]
    return orders.where(in_year(orders, "order_date", year)).agg(F.count("*").alias("order_count"))


def q25_recent_signups(shop: Shop, as_of: str, months: int = 6) -> DataFrame:
    customers = shop["customers"]
    since = F.add_months(F.lit(as_of).cast("date"), -months)
    recent = F.col("signup_date") >= like_column(customers, "signup_date", since)
    return customers.where(recent).select("name", "signup_date")


# ---- four tables ----

def q26_purchases_of_tier(shop: Shop, tier: str) -> DataFrame:
    customers = shop["customers"].where(F.col("tier") == tier).select(
        "customer_id", F.col("name").alias("customer_name")
    )
    products = shop["products"].select("product_id", F.col("name").alias("product_name"))
    orders = shop["orders"].select("order_id", "customer_id").join(customers, "customer_id")
    items = shop["order_items"].select("order_id", "product_id", "quantity")
    return (
        items.join(orders, "order_id")
        .join(products, "product_id")
        .select("order_id", "customer_name", "product_name", "quantity")
    )


# ---- variants a predictor wrote ----

def q27_orders_of_status_with_zeros(shop: Shop, status: str) -> DataFrame:
    """Every customer appears; the status test belongs to the right side."""
    counts = _orders_per_customer(shop["orders"].where(F.col("status") == status), "order_id")
    named = _names(shop).join(counts, "customer_id", "left")
    return named.orderBy("customer_id").select(
        "name", F.coalesce("order_count", F.lit(0)).alias("order_count")
    )


def q28_count_in_where(shop: Shop, n: int) -> DataFrame:
    """A correlated count in WHERE, as SQL; Spark turns it into one
    aggregation and a join."""
    sql = """
        SELECT c.name FROM {customers} c
        WHERE (SELECT COUNT(*) FROM {orders} o WHERE o.customer_id = c.customer_id) > :n
        ORDER BY c.name
    """
    return run(shop["orders"].sparkSession, sql, shop, n=n)
