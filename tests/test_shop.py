"""The workload on the shop's own tables, against DuckDB on the same files, and
the shop's constraints."""

import random
from datetime import date, timedelta

import duckdb
import pytest

from tallyframe.plans import workload as w
from tallyframe.plans.shop import ORDER_STATUSES, SHOP_SCHEMAS, TICKET_PRIORITIES, TIERS, check_shop, load_shop

CATEGORIES = ["Books", "Toys", "Home"]
COUNTRIES = ["UK", "Peru", "Japan"]


def _make(spark, folder):
    rng = random.Random(3)

    def day():
        return date(2023, 1, 1) + timedelta(days=rng.randrange(1300))

    people = range(1, 61)
    products = [(i, f"p{i}", CATEGORIES[i % 3], round(rng.uniform(8, 300), 2), i) for i in range(1, 10)]
    orders = [(i, rng.choice([1, 1, 1, *range(2, 50)]), day(), rng.choice(ORDER_STATUSES)) for i in range(1, 301)]
    items = [(i, rng.randrange(1, 301), rng.randrange(1, 9), rng.randrange(1, 4), 0.0) for i in range(1, 1001)]
    items = [(*x[:4], products[x[2] - 1][3]) for x in items]
    rows = {
        "customers": [(i, f"name{i % 50}", f"m{i}@x", rng.choice(COUNTRIES), day(), rng.choice(TIERS)) for i in people],
        "employees": [(i, f"e{i}", "agent", day(), None if i < 3 else rng.choice([1, 2])) for i in range(1, 9)],
        "products": products,
        "orders": orders,
        "order_items": items,
        "reviews": [(i, rng.randrange(1, 7), rng.choice(people), rng.randrange(1, 6), day(), None) for i in range(1, 120)],
        "support_tickets": [
            (i, rng.choice(people), rng.choice([None, 5]), rng.choice([None, 1, 2, 3, 4, 5]),
             "open", rng.choice(TICKET_PRIORITIES), day()) for i in range(1, 80)
        ],
    }
    for name, data in rows.items():
        spark.createDataFrame(data, SHOP_SCHEMAS[name]).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shop"))
    _make(spark, folder)
    con = duckdb.connect()
    for name in SHOP_SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return load_shop(spark, folder), con


CUSTOMER_ORDERS = "customers c JOIN orders o USING (customer_id)"
ITEMS = f"{CUSTOMER_ORDERS} JOIN order_items i USING (order_id) JOIN products p USING (product_id)"
CASES = {
    "q01": (lambda s: w.q01_customers_in_country(s, "UK"), "SELECT name FROM customers WHERE country = 'UK'"),
    "q02": (lambda s: w.q02_count_orders_with_status(s, "shipped"),
            "SELECT count(*) FROM orders WHERE status = 'shipped'"),
    "q03": (lambda s: w.q03_products_of_category(s, "Toys"),
            "SELECT name, price FROM products WHERE category = 'Toys' ORDER BY price"),
    "q04": (lambda s: w.q04_count_customers_of_tier(s, "gold"),
            "SELECT count(*) FROM customers WHERE tier = 'gold'"),
    "q05": (w.q05_average_price_per_category,
            "SELECT category, round(avg(price), 2) FROM products GROUP BY 1 ORDER BY 1"),
    "q06": (w.q06_total_revenue, "SELECT round(sum(quantity * unit_price), 2) FROM order_items"),
    "q07": (lambda s: w.q07_orders_of_status_per_customer(s, "pending"),
            f"SELECT name, count(*) FROM {CUSTOMER_ORDERS} WHERE status = 'pending' "
            "GROUP BY customer_id, name ORDER BY 2 DESC, customer_id"),
    "q08": (w.q08_orders_with_customer, f"SELECT order_id, name, country FROM {CUSTOMER_ORDERS}"),
    "q09": (lambda s: w.q09_buyers_of_category(s, "Books"),
            f"SELECT DISTINCT c.name FROM {ITEMS} WHERE category = 'Books'"),
    "q10": (w.q10_average_rating_per_product,
            "SELECT name, round(avg(rating), 2) FROM products JOIN reviews USING (product_id) "
            "GROUP BY product_id, name ORDER BY 2 DESC, product_id"),
    "q11": (lambda s: w.q11_tickets_with_people(s, "high"),
            "SELECT ticket_id, c.name, e.name FROM support_tickets t JOIN customers c USING (customer_id) "
            "LEFT JOIN employees e ON employee_id = assigned_employee_id WHERE priority = 'high'"),
    "q12": (w.q12_employees_with_manager,
            "SELECT e.name, m.name FROM employees e LEFT JOIN employees m ON e.manager_id = m.employee_id"),
    "q13": (w.q13_top_of_hierarchy, "SELECT name FROM employees WHERE manager_id IS NULL"),
    "q14": (lambda s: w.q14_top_products_by_price(s, 3),
            "SELECT name, price FROM products ORDER BY price DESC, product_id LIMIT 3"),
    "q15": (lambda s: w.q15_top_spenders(s, "delivered"),
            f"SELECT c.name, round(sum(quantity * unit_price), 2) FROM {ITEMS} WHERE status = 'delivered' "
            "GROUP BY c.customer_id, c.name ORDER BY 2 DESC, c.customer_id LIMIT 5"),
    "q16": (lambda s: w.q16_customers_with_more_orders(s, 5),
            f"SELECT name, count(*) FROM {CUSTOMER_ORDERS} GROUP BY customer_id, name "
            "HAVING count(*) > 5 ORDER BY 2 DESC, customer_id"),
    "q17": (lambda s: w.q17_expensive_categories(s, 100),
            "SELECT category, round(avg(price), 2) FROM products GROUP BY 1 HAVING avg(price) > 100"),
    "q18": (w.q18_customers_without_orders,
            "SELECT name FROM customers LEFT JOIN orders USING (customer_id) WHERE order_id IS NULL"),
    "q19": (w.q19_products_without_reviews,
            "SELECT name FROM products LEFT JOIN reviews USING (product_id) WHERE review_id IS NULL"),
    "q20": (w.q20_employees_without_tickets,
            "SELECT name FROM employees LEFT JOIN support_tickets ON assigned_employee_id = employee_id "
            "WHERE ticket_id IS NULL"),
    "q21": (w.q21_products_above_average,
            "SELECT name, price FROM products WHERE price > (SELECT avg(price) FROM products)"),
    "q22": (w.q22_customers_above_average_orders,
            f"SELECT name, count(order_id) FROM {CUSTOMER_ORDERS} GROUP BY customer_id, name "
            "HAVING count(order_id) > (SELECT avg(n) FROM (SELECT count(*) AS n FROM orders GROUP BY customer_id))"),
    "q23": (lambda s: w.q23_bought_every_product(s, "Toys"),
            "SELECT name FROM customers c WHERE NOT EXISTS (SELECT 1 FROM products p WHERE category = 'Toys' "
            "AND NOT EXISTS (SELECT 1 FROM orders o JOIN order_items i USING (order_id) "
            "WHERE o.customer_id = c.customer_id AND i.product_id = p.product_id))"),
    "q24": (lambda s: w.q24_orders_in_year(s, 2024), "SELECT count(*) FROM orders WHERE year(order_date) = 2024"),
    "q25": (lambda s: w.q25_recent_signups(s, "2026-08-20"),
            "SELECT name, signup_date FROM customers WHERE signup_date >= DATE '2026-02-20'"),
    "q26": (lambda s: w.q26_purchases_of_tier(s, "silver"),
            f"SELECT order_id, c.name, p.name, quantity FROM {ITEMS} WHERE tier = 'silver'"),
    "q27": (lambda s: w.q27_orders_of_status_with_zeros(s, "pending"),
            "SELECT name, count(order_id) FROM customers c LEFT JOIN orders o ON o.customer_id = c.customer_id "
            "AND status = 'pending' GROUP BY c.customer_id, name ORDER BY c.customer_id"),
    "q28": (lambda s: w.q28_count_in_where(s, 5),
            "SELECT name FROM customers c WHERE (SELECT count(*) FROM orders o "
            "WHERE o.customer_id = c.customer_id) > 5 ORDER BY name"),
}


@pytest.mark.parametrize("case", list(CASES))
def test_query(shop, case):
    tables, con = shop
    build, sql = CASES[case]
    got = [tuple(r) for r in build(tables).collect()]
    want = con.execute(sql).fetchall()
    assert want
    if "ORDER BY" in sql:
        assert got == want
    else:
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_constraints_hold_and_violations_are_counted(shop):
    tables, _ = shop
    assert {r.violations for r in check_shop(tables).collect()} == {0}

    twice = tables["orders"].unionByName(tables["orders"].where("order_id = 7"))
    bad = tables.using(
        orders=twice.selectExpr("order_id", "customer_id + if(order_id = 9, 1000, 0) AS customer_id",
                                "if(order_id = 8, NULL, order_date) AS order_date",
                                "if(order_id = 10, 'lost', status) AS status"),
        reviews=tables["reviews"].selectExpr("review_id", "product_id", "customer_id",
                                             "rating + if(review_id = 1, 9, 0) AS rating", "review_date", "comment"),
    )
    broken = {r.rule: r.violations for r in check_shop(bad).collect() if r.violations}
    assert broken == {
        "orders(order_id) primary key": 1, "orders.customer_id references customer_id": 1,
        "orders.order_date not null": 1, "orders.status in domain": 1, "reviews.rating in range": 1,
    }
