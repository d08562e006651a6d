"""Constraint checks on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import checks as c
from tallyframe.plans.catalog.registry import query


@query("c01_not_null", """
    WITH x AS (SELECT e.*, s_suppkey FROM events e LEFT JOIN supplier ON s_suppkey = user_id)
    SELECT 'events.user_id not null' AS rule, count(*) FILTER (user_id IS NULL) AS violations FROM x
    UNION ALL SELECT 'events.s_suppkey not null', count(*) FILTER (s_suppkey IS NULL) FROM x""")
def _c01(t):
    agents = t["supplier"].select("s_suppkey")
    joined = t["events"].join(agents, F.col("user_id") == F.col("s_suppkey"), "left")
    return c.check_not_null(joined, ["user_id", "s_suppkey"], "events")


@query("c02_domain", """
    SELECT 'orders.o_orderstatus in domain' AS rule,
           count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS violations FROM orders""")
def _c02(t):
    return c.check_domain(t["orders"], "o_orderstatus", ["O", "F"], "orders")


@query("c03_range", """
    SELECT 'lineitem.l_linenumber in range' AS rule,
           count(*) FILTER (l_linenumber NOT BETWEEN 1 AND 5) AS violations FROM lineitem""")
def _c03(t):
    return c.check_range(t["lineitem"], "l_linenumber", 1, 5, "lineitem")


@query("c04_unique", """
    SELECT 'lineitem(l_orderkey, l_linenumber) unique' AS rule, cast(sum(n - 1) AS bigint) AS violations
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def _c04(t):
    return c.check_unique(t["lineitem"], ["l_orderkey", "l_linenumber"], "lineitem")


@query("c05_primary_key", """
    WITH x AS (SELECT CASE WHEN l_linenumber < 7 THEN l_orderkey END AS k FROM lineitem)
    SELECT 'lineitem(k) primary key' AS rule,
           count(*) FILTER (k IS NULL) + count(k) - count(DISTINCT k) AS violations FROM x""")
def _c05(t):
    keys = t["lineitem"].select(F.when(F.col("l_linenumber") < 7, F.col("l_orderkey")).alias("k"))
    return c.check_primary_key(keys, ["k"], "lineitem")


@query("c06_foreign_key", """
    SELECT 'events.user_id references s_suppkey' AS rule, count(*) AS violations
    FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT s_suppkey FROM supplier)""")
def _c06(t):
    return c.check_foreign_key(t["events"], "user_id", t["supplier"], "s_suppkey", "events")


@query("c06_self_reference", """
    WITH x AS (SELECT conv_id * 1000000 + turn AS me,
                      CASE WHEN turn > 0 AND turn % 3 = 2 THEN -1 - conv_id
                           WHEN turn > 0 THEN conv_id * 1000000 + turn - 1 END AS boss
               FROM conversations)
    SELECT 'turns.boss references me' AS rule, count(*) AS violations FROM x
    WHERE boss IS NOT NULL AND boss NOT IN (SELECT me FROM x)""")
def _c06_self(t):
    me = F.col("conv_id") * 1_000_000 + F.col("turn")
    lost = F.when(F.col("turn") % 3 == 2, -1 - F.col("conv_id")).otherwise(me - 1)
    turns = t["conversations"].select(me.alias("me"), F.when(F.col("turn") > 0, lost).alias("boss"))
    return c.check_foreign_key(turns, "boss", turns, "me", "turns")


# The constraints of the star schema, some of them broken by the tables.
_RULES = {
    "nation": c.Rules(("n_nationkey",), ("n_name",), unique=(("n_name",), ("n_regionkey",)), references={"n_regionkey": "region"}),
    "region": c.Rules(("r_regionkey",), ("r_name",)),
    "customer": c.Rules(("c_custkey",), ("c_name",), {"c_mktsegment": ["BUILDING", "MACHINERY"]}, {"c_acctbal": (0, 9000)}, references={"c_nationkey": "nation"}),
    "supplier": c.Rules(("s_suppkey",), ("s_name",), references={"s_nationkey": "nation"}),
    "part": c.Rules(("p_partkey",), ranges={"p_size": (1, 40)}, unique=(("p_brand", "p_type", "p_size"),)),
    "orders": c.Rules(("o_orderkey",), ("o_custkey", "o_orderdate"), {"o_orderstatus": ["O", "F"]}, references={"o_custkey": "customer"}),
    "lineitem": c.Rules(("l_orderkey", "l_linenumber"), ranges={"l_discount": (0, 0.08)},
                        references={"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": c.Rules(("event_id",), ("props",), references={"user_id": "supplier"}),
    "labels": c.Rules(("doc_id",), domains={"quality": [1]}, references={"doc_id": "documents"}),
    "documents": c.Rules(("doc_id",), ("text",)),
    "conversations": c.Rules(("conv_id", "turn"), domains={"role": ["user", "assistant"]}, unique=(("conv_id",),)),
}


def _sql_rules() -> str:
    """Each rule as a statement of its own."""
    parts = []

    def part(rule: str, table: str, count: str) -> None:
        parts.append(f"SELECT '{rule}' AS rule, CAST(coalesce({count}, 0) AS BIGINT) AS violations FROM {table}")

    for table, r in _RULES.items():
        for column in r.required:
            part(f"{table}.{column} not null", table, f"count(*) FILTER ({column} IS NULL)")
        for column, values in r.domains.items():
            inside = ", ".join(repr(v) for v in values)
            part(f"{table}.{column} in domain", table, f"count(*) FILTER ({column} NOT IN ({inside}))")
        for column, (low, high) in r.ranges.items():
            part(f"{table}.{column} in range", table, f"count(*) FILTER ({column} NOT BETWEEN {low} AND {high})")
        key = ", ".join(r.primary_key)
        null_part = " OR ".join(f"{k} IS NULL" for k in r.primary_key)
        part(f"{table}({key}) primary key", f"(SELECT count(*) AS n, {null_part} AS nulls FROM {table} GROUP BY {key}, nulls)",
             "sum(CASE WHEN nulls THEN n ELSE n - 1 END)")
        for columns in r.unique:
            key = ", ".join(columns)
            known = " AND ".join(f"{k} IS NOT NULL" for k in columns)
            part(f"{table}({key}) unique", f"(SELECT count(*) AS n FROM {table} WHERE {known} GROUP BY {key})", "sum(n - 1)")
        for column, parent in r.references.items():
            target = _RULES[parent].primary_key[0]
            part(f"{table}.{column} references {target}", table,
                 f"count(*) FILTER ({column} IS NOT NULL AND {column} NOT IN (SELECT {target} FROM {parent} WHERE {target} IS NOT NULL))")
    return " UNION ALL ".join(parts)


@query("c_check_tables", _sql_rules())
def _all_rules(t):
    """All constraints of eleven tables in one plan, each table read once."""
    return c.check_tables(t, _RULES)
