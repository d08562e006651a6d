"""The workload on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.division import bitmaps, divide, holders, numbered
from tallyframe.plans import workload as w
from tallyframe.plans.catalog.registry import query, sql_round
from tallyframe.plans.shop import shop_view
from tallyframe.sources.tables import Tables


def _shop(t: Tables, **roles: str | DataFrame) -> Tables:
    return shop_view(t, t.spark).using(**roles)


@query("q01_customers_in_country", """
    SELECT c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE n_name = 'NATION_7'""")
def _q01(t):
    return w.q01_customers_in_country(_shop(t, customers="customers_by_country"), "NATION_7")


@query("q02_count_orders_with_status", """
    SELECT count(*) AS order_count FROM orders WHERE o_orderstatus = 'P'""")
def _q02(t):
    return w.q02_count_orders_with_status(_shop(t), "P")


@query("q03_products_of_category", """
    SELECT p_name AS name, p_retailprice AS price FROM part WHERE p_type = 'PROMO'
    ORDER BY p_retailprice, p_partkey""")
def _q03(t):
    return w.q03_products_of_category(_shop(t), "PROMO")


@query("q04_count_customers_of_tier", """
    SELECT count(*) AS customer_count FROM customer WHERE c_mktsegment = 'BUILDING'""")
def _q04(t):
    return w.q04_count_customers_of_tier(_shop(t), "BUILDING")


@query("q05_average_price_per_category", f"""
    SELECT p_type AS category, {sql_round('avg(p_retailprice)')} AS avg_price
    FROM part GROUP BY p_type ORDER BY p_type""")
def _q05(t):
    return w.q05_average_price_per_category(_shop(t))


@query("q06_total_revenue", """
    SELECT round(sum(l_quantity * l_extendedprice), 2) AS revenue FROM lineitem""")
def _q06(t):
    return w.q06_total_revenue(_shop(t))


@query("q07_orders_of_status_per_customer", """
    SELECT c_name AS name, count(*) AS order_count
    FROM customer JOIN orders ON o_custkey = c_custkey
    WHERE o_orderstatus = 'P' GROUP BY c_custkey, c_name
    ORDER BY order_count DESC, c_custkey""")
def _q07(t):
    return w.q07_orders_of_status_per_customer(_shop(t), "P")


@query("q08_orders_with_customer", """
    SELECT o_orderkey AS order_id, c_name AS name, n_name AS country
    FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey""")
def _q08(t):
    return w.q08_orders_with_customer(_shop(t, customers="customers_by_country"))


@query("q09_buyers_of_category", """
    SELECT DISTINCT c_name AS name FROM customer
    JOIN orders ON o_custkey = c_custkey
    JOIN lineitem ON l_orderkey = o_orderkey
    JOIN part ON p_partkey = l_partkey
    WHERE p_brand = 'Brand#7'""")
def _q09(t):
    return w.q09_buyers_of_category(_shop(t, products=_by_brand(t)), "Brand#7")


def _by_brand(t: Tables) -> DataFrame:
    return t["part"].select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("category"),
    )


@query("q10_average_rating_per_product", f"""
    SELECT p_name AS name, {sql_round('avg(l_linenumber)')} AS avg_rating
    FROM part JOIN lineitem ON l_partkey = p_partkey
    GROUP BY p_partkey, p_name ORDER BY avg_rating DESC, p_partkey""")
def _q10(t):
    return w.q10_average_rating_per_product(_shop(t))


@query("q11_tickets_with_people", """
    SELECT event_id AS ticket_id, c_name AS customer_name, s_name AS employee_name
    FROM events JOIN customer ON c_custkey = user_id
    LEFT JOIN supplier ON s_suppkey = user_id
    WHERE event_type = 'error'""")
def _q11(t):
    return w.q11_tickets_with_people(_shop(t, employees="agents"), "error")


_STAFF_NAME = "{0}.conv_id || '-' || {0}.turn || '-' || {0}.role"


@query("q12_employees_with_manager", f"""
    SELECT {_STAFF_NAME.format('e')} AS employee_name, {_STAFF_NAME.format('m')} AS manager_name
    FROM conversations e
    LEFT JOIN conversations m ON m.conv_id = e.conv_id AND m.turn = e.turn - 1""")
def _q12(t):
    return w.q12_employees_with_manager(_shop(t))


@query("q13_top_of_hierarchy", f"""
    SELECT {_STAFF_NAME.format('e')} AS name FROM conversations e WHERE turn = 0""")
def _q13(t):
    return w.q13_top_of_hierarchy(_shop(t))


@query("q14_top_products_by_price", """
    SELECT p_name AS name, p_retailprice AS price FROM part
    ORDER BY p_retailprice DESC, p_partkey LIMIT 10""")
def _q14(t):
    return w.q14_top_products_by_price(_shop(t), 10)


_TOP_SPENDERS = """
    SELECT c_name AS name, round(sum(l_quantity * l_extendedprice), 2) AS total_spent
    FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'
    JOIN lineitem ON l_orderkey = o_orderkey
    GROUP BY c_custkey, c_name ORDER BY total_spent DESC, c_custkey LIMIT 5"""


@query("q15_top_spenders", _TOP_SPENDERS)
def _q15(t):
    return w.q15_top_spenders(_shop(t), "F")


@query("q16_customers_with_more_orders", """
    SELECT c_name AS name, count(*) AS order_count
    FROM customer JOIN orders ON o_custkey = c_custkey
    GROUP BY c_custkey, c_name HAVING count(*) > 12
    ORDER BY order_count DESC, c_custkey""")
def _q16(t):
    return w.q16_customers_with_more_orders(_shop(t), 12)


@query("q17_expensive_categories", f"""
    SELECT p_brand AS category, {sql_round('avg(p_retailprice)')} AS avg_price
    FROM part GROUP BY p_brand HAVING avg(p_retailprice) > 945""")
def _q17(t):
    products = t["part"].select(
        F.col("p_brand").alias("category"), F.col("p_retailprice").alias("price")
    )
    return w.q17_expensive_categories(_shop(t, products=products), 945)


@query("q18_customers_without_orders", """
    SELECT 'order ' || o_orderkey AS name FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
    WHERE l_orderkey IS NULL""")
def _q18(t):
    """Every customer ordered, so orders play customers and their lines play orders."""
    customers = t["orders"].select(
        F.col("o_orderkey").alias("customer_id"), F.concat_ws(" ", F.lit("order"), "o_orderkey").alias("name")
    )
    orders = t["lineitem"].select(F.col("l_orderkey").alias("customer_id"))
    return w.q18_customers_without_orders(_shop(t, customers=customers, orders=orders))


@query("q19_products_without_reviews", """
    SELECT d.doc_id || '-' || d.lang AS name FROM documents d
    LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL""")
def _q19(t):
    products = t["documents"].select(
        F.col("doc_id").alias("product_id"), F.concat_ws("-", "doc_id", "lang").alias("name")
    )
    reviews = t["labels"].select(F.col("doc_id").alias("product_id"))
    return w.q19_products_without_reviews({"products": products, "reviews": reviews})


@query("q20_employees_without_tickets", """
    SELECT c_name AS name FROM customer LEFT JOIN events ON user_id = c_custkey
    WHERE event_id IS NULL""")
def _q20(t):
    employees = t["customer"].select(
        F.col("c_custkey").alias("employee_id"), F.col("c_name").alias("name")
    )
    return w.q20_employees_without_tickets(_shop(t, employees=employees))


@query("q21_products_above_average", """
    SELECT p_name AS name, p_retailprice AS price FROM part
    WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)""")
def _q21(t):
    return w.q21_products_above_average(_shop(t))


@query("q22_customers_above_average_orders", """
    SELECT c_name AS name, count(o_orderkey) AS order_count
    FROM customer JOIN orders ON o_custkey = c_custkey
    GROUP BY c_custkey, c_name HAVING count(o_orderkey) > (
        SELECT avg(cnt) FROM (SELECT count(*) AS cnt FROM orders GROUP BY o_custkey))""")
def _q22(t):
    return w.q22_customers_above_average_orders(_shop(t))


# The double NOT EXISTS of the division, as counts: the covered values of each
# customer against the number of needed values.
_BOUGHT = "JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"


_KIND = "p_brand || ' ' || p_type || ' ' || p_size"


@query("q23_bought_every_product", f"""
    SELECT c_name AS name FROM customer WHERE (
        SELECT count(DISTINCT l_partkey) FROM orders {_BOUGHT}
        WHERE o_custkey = c_custkey AND {_KIND} = 'Brand#2 ECONOMY 11'
    ) = (SELECT count(*) FROM part WHERE {_KIND} = 'Brand#2 ECONOMY 11')""")
def _q23(t):
    """Narrow categories of a few products each."""
    products = t["part"].select(
        F.col("p_partkey").alias("product_id"),
        F.concat_ws(" ", "p_brand", "p_type", "p_size").alias("category"),
    )
    return w.q23_bought_every_product(_shop(t, products=products), "Brand#2 ECONOMY 11")


@query("q23_bought_every_brand", f"""
    SELECT c_name AS name FROM customer WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT DISTINCT p_brand AS brand FROM part) b WHERE NOT EXISTS (
            SELECT 1 FROM orders {_BOUGHT} WHERE o_custkey = c_custkey AND p_brand = b.brand))""")
def _q23_brand(t):
    shop = _shop(t)
    brands = _by_brand(t).select("product_id", F.col("category").alias("brand"))
    # Parts become numbers of brands before the items come in.
    numbers = numbered(brands, "brand")
    items = shop["order_items"].select("order_id", "product_id").join(brands.join(numbers, "brand"), "product_id")
    orders = shop["orders"].select("order_id", "customer_id")
    bought = bitmaps(items.join(orders, "order_id"), "customer_id")
    customers = shop["customers"].select("customer_id", "name")
    return holders(customers, bought, numbers, "customer_id").select("name")


@query("q23_nothing_needed", """
    SELECT c_name AS name FROM customer WHERE NOT EXISTS (
        SELECT 1 FROM part WHERE p_brand = 'no such brand')""")
def _q23_empty(t):
    return w.q23_bought_every_product(_shop(t, products=_by_brand(t)), "no such brand")


@query("j09_flags_with_every_part", """
    SELECT flag FROM (SELECT l_returnflag AS flag, count(DISTINCT l_partkey) AS n FROM lineitem
                      WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY l_returnflag)
    WHERE n = (SELECT count(DISTINCT p_partkey) FROM part)""")
def _j09(t):
    """Three keys that hold all rows, with as many needed values as there are parts."""
    flags = t["lineitem"].select(F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"))
    parts = t["part"].select(F.col("p_partkey").alias("part"))
    return divide(flags.select("flag").distinct(), flags, parts, "flag", "part")


@query("q24_orders_in_year", """
    SELECT count(*) AS order_count FROM orders WHERE strftime(o_orderdate, '%Y') = '1998'""")
def _q24(t):
    return w.q24_orders_in_year(_shop(t), 1998)


@query("q25_recent_signups", """
    SELECT CAST(o_orderkey AS VARCHAR) AS name, o_orderdate AS signup_date FROM orders
    WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 6 MONTH""")
def _q25(t):
    signups = t["orders"].select(
        F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderdate").alias("signup_date")
    )
    return w.q25_recent_signups({"customers": signups}, "2001-08-01")


@query("q26_purchases_of_tier", """
    SELECT o_orderkey AS order_id, c_name AS customer_name, p_name AS product_name,
           l_quantity AS quantity
    FROM customer JOIN orders ON o_custkey = c_custkey
    JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
    WHERE c_mktsegment = 'MACHINERY'""")
def _q26(t):
    return w.q26_purchases_of_tier(_shop(t), "MACHINERY")


@query("q27_orders_of_status_with_zeros", """
    SELECT c_name AS name, count(o_orderkey) AS order_count
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'
    GROUP BY c_custkey, c_name ORDER BY c_custkey""")
def _q27(t):
    return w.q27_orders_of_status_with_zeros(_shop(t), "P")


@query("q28_count_in_where", """
    SELECT c_name AS name FROM customer
    WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 12 ORDER BY c_name""")
def _q28(t):
    return w.q28_count_in_where(_shop(t), 12)
