"""Single relational and scalar steps that no composed query shows on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import text as tx
from tallyframe.functions.values import shift_months
from tallyframe.operators import comparison as cmp
from tallyframe.operators import positions as p
from tallyframe.operators import reporting as rep
from tallyframe.operators import sampling as s
from tallyframe.operators import scoring as sc
from tallyframe.plans.catalog.derived import SQL_CALLS, SQL_SCORED, calls, rounded, scored
from tallyframe.plans.catalog.registry import query, sql_hash, sql_round, sql_unit
from tallyframe.sources.tables import run


@query("p01_projection", "SELECT c_name, c_acctbal FROM customer")
def _p01(t):
    return t["customer"].select("c_name", "c_acctbal")


@query("p02_alias", """
    SELECT o_orderpriority AS priority, count(*) AS order_count FROM orders GROUP BY 1""")
def _p02(t):
    return t["orders"].groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("order_count")
    )


@query("p04_range_filter", """
    SELECT l_orderkey, l_shipdate, l_quantity FROM lineitem
    WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '2000-01-01'""")
def _p04(t):
    late = F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    rows = t["lineitem"].where((F.col("l_quantity") > 45) & late)
    return rows.select("l_orderkey", "l_shipdate", "l_quantity")


@query("p05_null_filter", f"""
    WITH {SQL_CALLS} SELECT event_id, predictor FROM calls WHERE cost_usd IS NULL""")
def _p05(t):
    return calls(t).where(F.col("cost_usd").isNull()).select("event_id", "predictor")


@query("p06_arithmetic", f"""
    SELECT l_orderkey, l_linenumber, {sql_round('l_quantity * l_extendedprice', 4)} AS amount
    FROM lineitem""")
def _p06(t):
    amount = F.round(F.col("l_quantity") * F.col("l_extendedprice"), 4).alias("amount")
    return t["lineitem"].select("l_orderkey", "l_linenumber", amount)


@query("p07_predicate_in_on", """
    SELECT c_custkey, o_orderkey FROM customer
    LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'
                    AND o_orderdate < TIMESTAMP '1996-01-01'""")
def _p07(t):
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    orders = t["orders"].where((F.col("o_orderstatus") == "P") & early)
    orders = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return t["customer"].select("c_custkey").join(orders, "c_custkey", "left")


@query("p08_case_when", """
    SELECT event_type, sum(CASE WHEN value > 20 THEN 1 ELSE 0 END)::bigint AS slow
    FROM events GROUP BY event_type""")
def _p08(t):
    slow = F.when(F.col("value") > 20, 1).otherwise(0)
    return t["events"].groupBy("event_type").agg(F.sum(slow).alias("slow"))


@query("p09_optional_filter", f"""
    WITH {SQL_CALLS} SELECT event_id, predictor FROM calls""")
def _p09(t):
    """An empty value means: no filter."""
    wanted = ""
    log = calls(t).select("event_id", "predictor")
    return log.where(F.col("predictor") == wanted) if wanted else log


@query("p10_conjunction", """
    SELECT o_orderkey FROM orders
    WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 200000""")
def _p10(t):
    chosen = (
        (F.col("o_orderstatus") == "F")
        & (F.col("o_orderpriority") == "1-URGENT")
        & (F.col("o_totalprice") > 200000)
    )
    return t["orders"].where(chosen).select("o_orderkey")


@query("p11_constant_false", "SELECT count(*) AS n FROM customer WHERE 1 = 0")
def _p11(t):
    """No row passes, one row with a zero comes out."""
    return t["customer"].where(F.lit(False)).agg(F.count("*").alias("n"))


@query("j04_left_outer", """
    SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _j04(t):
    labels = t["labels"].select("doc_id", "quality")
    return t["documents"].select("doc_id", "lang").join(labels, "doc_id", "left")


@query("j08_not_exists", """
    SELECT c_custkey FROM customer WHERE NOT EXISTS (
        SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def _j08(t):
    sql = """
        SELECT c_custkey FROM {customer} WHERE NOT EXISTS (
            SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > :price)
    """
    return run(t.spark, sql, t, price=400000)


@query("j12_last_wins", """
    SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _j12(t):
    events = t["events"].select("user_id", "event_id", "event_type")
    return sc.last_wins(events, "user_id", "event_id")


@query("j14_children_of_parent", f"""
    SELECT o_orderkey, o_custkey, item FROM orders JOIN (
        SELECT l_orderkey, l_partkey AS item, row_number() OVER (
            PARTITION BY l_orderkey ORDER BY {sql_hash(9, 'l_partkey')}, l_partkey) AS rn
        FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
    ) ON l_orderkey = o_orderkey
    WHERE rn = 1 AND o_orderstatus = 'F' AND {sql_unit(9, 'o_orderkey')} < 0.35""")
def _j14(t):
    """A sample of the finished orders, each with one of its items."""
    finished = t["orders"].where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")
    parents = s.bernoulli(finished, "o_orderkey", 0.35, 9)
    items = t["lineitem"].select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item")
    )
    wanted = items.join(parents.select("o_orderkey"), "o_orderkey", "left_semi").distinct()
    return parents.join(s.one_per_group(
        wanted.withColumn("_key", F.col("item")), "o_orderkey", "_key", 9
    ).drop("_key"), "o_orderkey")


@query("a14_sum_null_when_all_null", f"""
    WITH {SQL_CALLS} SELECT question, {sql_round('sum(cost_usd)', 9)} AS total_cost_usd
    FROM calls GROUP BY question""")
def _a14(t):
    return rounded(sc.total_cost(calls(t), ("question",)), 9)


@query("o04_row_cap", """
    SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS row_count,
           (SELECT count(*) FROM orders) > 200 AS truncated
    FROM orders ORDER BY o_orderkey LIMIT 200""")
def _o04(t):
    """The cap is the feature: the first 200 rows and the true count."""
    return rep.capped(t["orders"].select("o_orderkey", "o_totalprice"), 200, ["o_orderkey"])


@query("t01_concatenate", """
    SELECT doc_id, 'labelled' AS part FROM labels
    UNION ALL SELECT doc_id, 'all' FROM documents""")
def _t01(t):
    labelled = t["labels"].select("doc_id", F.lit("labelled").alias("part"))
    return labelled.unionByName(t["documents"].select(F.lit("all").alias("part"), "doc_id"))


@query("t04_category_union", f"WITH {SQL_SCORED} SELECT DISTINCT category FROM scored")
def _t04(t):
    return rep.category_names(sc.category_maps(scored(t)))


@query("f04_shift_months", """
    SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) - INTERVAL 6 MONTH
        + INTERVAL 1 DAY * (day(o_orderdate) - 1) AS DATE) AS earlier FROM orders""")
def _f04(t):
    day = F.col("o_orderdate").cast("date")
    return t["orders"].select("o_orderkey", shift_months(day, -6).alias("earlier"))


@query("f05_date_plus_days", """
    SELECT l_orderkey, l_linenumber, l_shipdate::date + cast(l_quantity AS integer) AS due
    FROM lineitem""")
def _f05(t):
    due = F.date_add(F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int"))
    return t["lineitem"].select("l_orderkey", "l_linenumber", due.alias("due"))


@query("f11_prefix_in_message", r"""
    SELECT doc_id, 'SQL must start with SELECT or WITH, got: '
        || CASE WHEN contains(head, '''') AND NOT contains(head, '"') THEN '"' || head || '"'
                ELSE '''' || replace(head, '''', '\''') || '''' END AS reason
    FROM (SELECT doc_id, replace(replace(replace(replace(substr('Note: ' || text, 1, 60),
        '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS head FROM documents)""")
def _f11(t):
    texts = t["documents"].select("doc_id", F.concat(F.lit("Note: "), "text").alias("sql"))
    return sc.screen_statements(texts, "sql").select("doc_id", "reason")


@query("f17_null_safe_equality", """
    SELECT event_id, (CASE WHEN user_id % 7 <> 0 THEN value END) IS NOT DISTINCT FROM
        (CASE WHEN user_id % 5 <> 0 THEN value END) AS same FROM events""")
def _f17(t):
    left = F.when(F.col("user_id") % 7 != 0, F.col("value"))
    right = F.when(F.col("user_id") % 5 != 0, F.col("value"))
    return t["events"].select("event_id", left.eqNullSafe(right).alias("same"))


@query("f17_cells_equal_across_types", """
    SELECT l_linenumber AS line, count(*) FILTER (l_quantity = 50 AND l_linenumber = 3) = 0
        AND count(*) FILTER (l_quantity = 1 AND l_linenumber = 4) = 0 AS matched
    FROM lineitem GROUP BY l_linenumber""")
def _f17_types(t):
    """The same numbers as integers and as reals, and a null column: equal.
    In line 3 some numbers are one more, in line 4 some nulls are empty texts."""
    line, quantity = F.col("l_linenumber"), F.col("l_quantity")
    nothing = F.lit(None).cast("string")
    gold = t["lineitem"].select(line.alias("line"), quantity, line, nothing.alias("n"))
    pred = t["lineitem"].select(
        line.alias("line"), (quantity + F.when((line == 3) & (quantity == 50), 1).otherwise(0)).cast("bigint"),
        line.cast("double"), F.when((line == 4) & (quantity == 1), "").otherwise(nothing).alias("m"),
    )
    return cmp.same_result(gold, pred, by="line")


@query("f18_iso_seconds", """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM events""")
def _f18(t):
    return t["events"].select("event_id", tx.iso_seconds("ts").alias("stamp"))


@query("f19_lower_and_concat", """
    SELECT c_custkey, lower(c_mktsegment) || '.' || lower(n_name) || c_custkey || '@example.com' AS email
    FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def _f19(t):
    joined = t["customer"].join(t["nation"], F.col("n_nationkey") == F.col("c_nationkey"))
    email = F.concat(
        F.lower("c_mktsegment"), F.lit("."), F.lower("n_name"),
        F.col("c_custkey").cast("string"), F.lit("@example.com"),
    )
    return joined.select("c_custkey", email.alias("email"))


@query("f20_padded_number", "SELECT event_id, printf('call-%04d', event_id) AS id FROM events")
def _f20(t):
    return t["events"].select("event_id", tx.padded_id(F.lit("call"), "event_id").alias("id"))


@query("o06_ids_per_part", f"""
    SELECT doc_id, split, printf('%s-%04d', split, row_number() OVER (
        PARTITION BY split ORDER BY {sql_hash(3, 'doc_id')}, doc_id) - 1) AS id
    FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'eval' ELSE 'train' END AS split FROM labels)""")
def _o06(t):
    """Numbering starts anew in each part."""
    split = F.when(F.col("toxic") == 1, "eval").otherwise("train").alias("split")
    rows = t["labels"].select("doc_id", split)
    numbered = p.assign_ids(rows, F.col("split"), "doc_id", 3, ("split",))
    return numbered.select("doc_id", "split", "id")
