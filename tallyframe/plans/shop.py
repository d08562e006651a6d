"""The shop's tables: schemas, constraints, and the shop seen in star-schema tables.

The workload is written against seven shop tables. ``shop_view`` presents the
star-schema tables in these roles by renaming columns, so filters and column
choices still reach the parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import checks
from tallyframe.sources.tables import Tables, load_tables

SHOP_SCHEMAS = {
    "customers": "customer_id bigint, name string, email string, country string, "
    "signup_date date, tier string",
    "employees": "employee_id bigint, name string, role string, hire_date date, "
    "manager_id bigint",
    "products": "product_id bigint, name string, category string, price double, "
    "stock_quantity bigint",
    "orders": "order_id bigint, customer_id bigint, order_date date, status string",
    "order_items": "order_item_id bigint, order_id bigint, product_id bigint, "
    "quantity bigint, unit_price double",
    "reviews": "review_id bigint, product_id bigint, customer_id bigint, rating bigint, "
    "review_date date, comment string",
    "support_tickets": "ticket_id bigint, customer_id bigint, order_id bigint, "
    "assigned_employee_id bigint, status string, priority string, created_date date",
}

# The columns that may be null and the closed value sets.
NULLABLE = {
    "employees": {"manager_id"},
    "reviews": {"comment"},
    "support_tickets": {"order_id", "assigned_employee_id"},
}
PRIMARY_KEYS = {
    "customers": "customer_id",
    "employees": "employee_id",
    "products": "product_id",
    "orders": "order_id",
    "order_items": "order_item_id",
    "reviews": "review_id",
    "support_tickets": "ticket_id",
}
TIERS = ["free", "silver", "gold", "platinum"]
ORDER_STATUSES = ["pending", "shipped", "delivered", "cancelled", "returned"]
TICKET_STATUSES = ["open", "in_progress", "resolved", "closed"]
TICKET_PRIORITIES = ["low", "medium", "high", "urgent"]
DOMAINS = {
    ("customers", "tier"): TIERS,
    ("orders", "status"): ORDER_STATUSES,
    ("support_tickets", "status"): TICKET_STATUSES,
    ("support_tickets", "priority"): TICKET_PRIORITIES,
}
RATING_RANGE = (1, 5)
FOREIGN_KEYS = [
    ("employees", "manager_id", "employees"),
    ("orders", "customer_id", "customers"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
    ("reviews", "product_id", "products"),
    ("reviews", "customer_id", "customers"),
    ("support_tickets", "customer_id", "customers"),
    ("support_tickets", "order_id", "orders"),
    ("support_tickets", "assigned_employee_id", "employees"),
]


def load_shop(spark: SparkSession, folder: str) -> Tables:
    return load_tables(spark, folder, SHOP_SCHEMAS)


def shop_rules() -> dict[str, checks.Rules]:
    """The shop's constraints by table."""
    rules = {}
    for table, key in PRIMARY_KEYS.items():
        columns = [c.split()[0] for c in SHOP_SCHEMAS[table].split(", ")]
        rules[table] = checks.Rules(
            primary_key=(key,),
            required=tuple(c for c in columns if c not in NULLABLE.get(table, set()) | {key}),
            domains={c: values for (owner, c), values in DOMAINS.items() if owner == table},
            ranges={"rating": RATING_RANGE} if table == "reviews" else {},
            unique=(("email",),) if table == "customers" else (),
            references={c: parent for child, c, parent in FOREIGN_KEYS if child == table},
        )
    return rules


def check_shop(shop: Mapping[str, DataFrame]) -> DataFrame:
    """All constraints of the shop: (rule, violations). Each table is read once."""
    return checks.check_tables(shop, shop_rules())


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def customers(t: Mapping[str, DataFrame], country: bool = False) -> DataFrame:
    """Customers; with ``country`` also the nation's name (a 25-row lookup)."""
    names = {"customer_id": "c_custkey", "name": "c_name", "tier": "c_mktsegment"}
    if not country:
        return _renamed(t["customer"], names)
    nation = t["nation"].select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return _renamed(t["customer"].join(nation, "c_nationkey"), {**names, "country": "n_name"})


def staff(t: Mapping[str, DataFrame]) -> DataFrame:
    """A hierarchy: each conversation turn reports to the turn before it."""
    me = F.col("conv_id") * 1_000_000 + F.col("turn")
    return t["conversations"].select(
        me.alias("employee_id"),
        F.concat_ws("-", "conv_id", "turn", "role").alias("name"),
        F.when(F.col("turn") > 0, me - 1).alias("manager_id"),
    )


def shop_view(t: Mapping[str, DataFrame], spark: SparkSession) -> Tables:
    return Tables(
        spark,
        {
            "customers": lambda: customers(t),
            "customers_by_country": lambda: customers(t, country=True),
            "orders": lambda: _renamed(
                t["orders"],
                {"order_id": "o_orderkey", "customer_id": "o_custkey",
                 "order_date": "o_orderdate", "status": "o_orderstatus"},
            ),
            "order_items": lambda: _renamed(
                t["lineitem"],
                {"order_id": "l_orderkey", "product_id": "l_partkey",
                 "quantity": "l_quantity", "unit_price": "l_extendedprice"},
            ),
            "products": lambda: _renamed(
                t["part"],
                {"product_id": "p_partkey", "name": "p_name", "category": "p_type",
                 "price": "p_retailprice"},
            ),
            "employees": lambda: staff(t),
            "agents": lambda: _renamed(
                t["supplier"], {"employee_id": "s_suppkey", "name": "s_name"}
            ),
            "reviews": lambda: _renamed(
                t["lineitem"],
                {"review_id": "l_orderkey", "product_id": "l_partkey", "rating": "l_linenumber"},
            ),
            "support_tickets": lambda: _renamed(
                t["events"],
                {"ticket_id": "event_id", "customer_id": "user_id",
                 "assigned_employee_id": "user_id", "priority": "event_type",
                 "created_date": "ts"},
            ),
        },
    )
