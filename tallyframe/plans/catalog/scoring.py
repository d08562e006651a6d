"""Result comparison, scoring and reports on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import collapse_space, percent
from tallyframe.operators import comparison as cmp
from tallyframe.operators import reporting as rep
from tallyframe.operators import scoring as sc
from tallyframe.plans.catalog.derived import PREDICTORS, SQL_SCORED, rounded, scored
from tallyframe.plans.catalog.registry import query, sql_round
from tallyframe.plans.evaluation import evaluate
from tallyframe.session import scratch_path
from tallyframe.sources import runs

# Every document becomes a statement or a model answer; which kind follows from
# its language, so all kinds occur.
_STATEMENT = """CASE lang WHEN 'en' THEN '  select ''' || text || ''' as t'
    WHEN 'de' THEN 'WITH x AS (' || text || ') SELECT updated_at FROM x'
    WHEN 'es' THEN '-- note' || chr(10) || 'SELECT 1 /*' || text || '*/'
    ELSE 'SELECT replace(t, ''' || text || ''', "") FROM docs' END"""


def _statements(t) -> DataFrame:
    text, lit, concat = F.col("text"), F.lit, F.concat
    statement = (
        F.when(F.col("lang") == "en", concat(lit("  select '"), text, lit("' as t")))
        .when(F.col("lang") == "de", concat(lit("WITH x AS ("), text, lit(") SELECT updated_at FROM x")))
        .when(F.col("lang") == "es", concat(lit("-- note\nSELECT 1 /*"), text, lit("*/")))
        .otherwise(concat(lit("SELECT replace(t, '"), text, lit("', \"\") FROM docs")))
    )
    return t["documents"].select("doc_id", "lang", statement.alias("sql"))


_WORDS = "insert|update|delete|drop|alter|create|attach|pragma|vacuum|replace"


@query("e01_screen_statements", rf"""
    WITH x AS (SELECT doc_id, {_STATEMENT} AS s FROM documents)
    SELECT doc_id, regexp_matches(s, '^\s*(?i:select|with)\b')
           AND NOT regexp_matches(s, '\b(?i:{_WORDS})\b') AS allowed,
           CASE WHEN NOT regexp_matches(s, '^\s*(?i:select|with)\b') THEN 'start'
                WHEN regexp_matches(s, '\b(?i:{_WORDS})\b') THEN 'word' END AS kind
    FROM x""")
def _e01(t):
    screened = sc.screen_statements(_statements(t), "sql")
    kind = F.when(F.startswith("reason", F.lit("SQL must start")), "start").when(
        F.startswith("reason", F.lit("SQL contains")), "word"
    )
    return screened.select("doc_id", "allowed", kind.alias("kind"))


@query("e02_extract_sql", r"""
    SELECT doc_id, trim(text, E' \t\n\r\f\v') AS sql FROM documents""")
def _e02(t):
    """Answers in several kinds of fence; inside is the text itself."""
    text, lit, concat = F.col("text"), F.lit, F.concat
    answer = (
        F.when(F.col("lang") == "en", concat(lit("```sql\n"), text, lit("\n```")))
        .when(F.col("lang") == "de", concat(lit(" \n```\n"), text, lit("\n  ```  ")))
        .when(F.col("lang") == "es", concat(lit("```sql\n"), text))
        .otherwise(concat(lit("\n  "), text, lit(" \n")))
    )
    answers = t["documents"].select("doc_id", answer.alias("answer"))
    return sc.extract_sql(answers, "answer").select("doc_id", "sql")


@query("e03_normalize_rows", """
    SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * (1 - l_discount) * 100, 0) / 100 AS net,
           l_quantity, l_returnflag FROM lineitem""")
def _e03(t):
    net = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")
    return cmp.normalize_rows(
        t["lineitem"].select("l_orderkey", "l_linenumber", net, "l_quantity", "l_returnflag")
    )


# Gold: the line items of each supplier. Predicted: per supplier the same rows,
# or with a change below or at the rounding, or some rows lost or doubled.
_CELLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]


def _supplier_results(t) -> tuple[DataFrame, DataFrame]:
    gold = t["lineitem"].select("l_suppkey", *_CELLS)
    kind = F.col("l_suppkey") % 5
    copies = F.when((kind == 3) & (F.col("l_quantity") == 50) & (F.col("l_linenumber") == 7), 0).when(
        (kind == 4) & (F.col("l_quantity") == 50) & (F.col("l_linenumber") == 1), 2
    ).otherwise(1)
    pred = gold.withColumn("l_extendedprice", F.col("l_extendedprice") + F.when(kind == 1, 0.001)
                           .when(kind == 2, 0.01).otherwise(0.0))
    pred = pred.withColumn("_i", F.explode(F.array_repeat(F.lit(1), copies))).drop("_i")
    # A different type and other names: only position and value count.
    pred = pred.select("l_suppkey", *[F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(_CELLS)])
    results = cmp.result_rows(gold, "l_suppkey", "gold", _CELLS).unionByName(
        cmp.result_rows(pred, "l_suppkey", "pred", ["p0", "p1", "p2", "p3"])
    )
    examples = t["supplier"].select(F.col("s_suppkey").alias("example_id"))
    return examples, results


_SQL_SUPPLIER = """gold AS (SELECT l_suppkey AS example_id, l_orderkey, l_linenumber, l_quantity,
        round(l_extendedprice, 2) AS price FROM lineitem),
    pred AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity,
        round(l_extendedprice + CASE l_suppkey % 5 WHEN 1 THEN 0.001 WHEN 2 THEN 0.01 ELSE 0 END, 2) AS price
        FROM lineitem JOIN range(2) r(i) ON i < CASE
            WHEN l_suppkey % 5 = 3 AND l_quantity = 50 AND l_linenumber = 7 THEN 0
            WHEN l_suppkey % 5 = 4 AND l_quantity = 50 AND l_linenumber = 1 THEN 2 ELSE 1 END),
    diff AS ((SELECT * FROM gold EXCEPT ALL SELECT * FROM pred) UNION ALL
             (SELECT * FROM pred EXCEPT ALL SELECT * FROM gold))"""


@query("e04_match_unordered", f"""
    WITH {_SQL_SUPPLIER}
    SELECT s_suppkey AS example_id, s_suppkey NOT IN (SELECT example_id FROM diff) AS matched
    FROM supplier""")
def _e04(t):
    return cmp.match_unordered(*_supplier_results(t))


@query("e04_same_result", """
    WITH gold AS (SELECT p_brand, p_partkey, p_type, round(p_retailprice, 2) AS price FROM part),
    pred AS (SELECT p_brand, p_partkey, p_type, round(p_retailprice + CASE
        WHEN p_brand LIKE '%1' AND p_size = 7 THEN 0.01 ELSE 0.001 END, 2) AS price FROM part
        WHERE NOT (p_brand LIKE '%2' AND p_size = 9)),
    diff AS ((SELECT * FROM gold EXCEPT ALL SELECT * FROM pred) UNION ALL
             (SELECT * FROM pred EXCEPT ALL SELECT * FROM gold))
    SELECT DISTINCT p_brand, p_brand NOT IN (SELECT p_brand FROM diff) AS matched FROM part""")
def _e04_pair(t):
    """A pair of results, compared brand by brand: the same below the rounding,
    but some brands have a cent more somewhere or lack rows."""
    brand, price = F.col("p_brand"), F.col("p_retailprice")
    gold = t["part"].select("p_brand", "p_partkey", "p_type", "p_retailprice")
    dearer = F.when(brand.endswith("1") & (F.col("p_size") == 7), 0.01).otherwise(0.001)
    pred = t["part"].where(~(brand.endswith("2") & (F.col("p_size") == 9))).select(
        "p_brand", F.col("p_partkey").alias("a"), F.col("p_type").alias("b"), (price + dearer).alias("c")
    )
    return cmp.same_result(gold, pred, by="p_brand")


# Orders per customer, placed by their key. A third of the customers keep the
# order, a third get it reversed, a third get values changed below the rounding.
def _customer_results(t) -> DataFrame:
    gold = t["orders"].select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    kind = F.col("o_custkey") % 3
    place = F.when(kind == 1, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    price = F.col("o_totalprice") + F.when(kind == 2, 0.001).otherwise(0.0)
    pred = gold.withColumn("o_totalprice", price).withColumn("place", place)
    cells = ["o_orderstatus", "o_totalprice"]
    return cmp.result_rows(gold, "o_custkey", "gold", cells, "o_orderkey").unionByName(
        cmp.result_rows(pred, "o_custkey", "pred", cells, "place")
    )


_SQL_CUSTOMER = """gold AS (SELECT o_custkey AS example_id, o_orderkey AS pos, o_orderstatus,
        round(o_totalprice, 2) AS price FROM orders),
    pred AS (SELECT o_custkey AS example_id,
        CASE WHEN o_custkey % 3 = 1 THEN -o_orderkey ELSE o_orderkey END AS pos, o_orderstatus,
        round(o_totalprice + CASE WHEN o_custkey % 3 = 2 THEN 0.001 ELSE 0 END, 2) AS price FROM orders)"""


@query("e05_match_ordered", f"""
    WITH {_SQL_CUSTOMER}, bad AS (
        SELECT DISTINCT coalesce(g.example_id, p.example_id) AS example_id
        FROM gold g FULL JOIN pred p ON g.example_id = p.example_id AND g.pos = p.pos
        WHERE g.price IS DISTINCT FROM p.price OR g.o_orderstatus IS DISTINCT FROM p.o_orderstatus)
    SELECT c_custkey AS example_id, c_custkey NOT IN (SELECT example_id FROM bad) AS matched
    FROM customer""")
def _e05(t):
    examples = t["customer"].select(F.col("c_custkey").alias("example_id"))
    return cmp.match_ordered(examples, _customer_results(t))


_ORDER_TEXT = """CASE c_mktsegment WHEN 'BUILDING' THEN 'SELECT a FROM t ORDER  BY a'
    WHEN 'MACHINERY' THEN 'select a from (select a from t order by a limit 5)'
    WHEN 'FURNITURE' THEN 'SELECT reorder, byte FROM border' ELSE 'SELECT a FROM t' END"""


@query("e06_is_ordered", f"""
    SELECT c_custkey, regexp_matches({_ORDER_TEXT}, '(?i)\\border\\s+by\\b') AS ordered FROM customer""")
def _e06(t):
    statements = t["customer"].select("c_custkey", F.expr(_ORDER_TEXT).alias("sql"))
    return cmp.flag_ordered(statements).select("c_custkey", "ordered")


@query("e06_match_by_statement", f"""
    WITH {_SQL_CUSTOMER}, bad AS (
        SELECT DISTINCT coalesce(g.example_id, p.example_id) AS example_id
        FROM gold g FULL JOIN pred p ON g.example_id = p.example_id AND g.pos = p.pos
        WHERE g.price IS DISTINCT FROM p.price OR g.o_orderstatus IS DISTINCT FROM p.o_orderstatus)
    SELECT c_custkey AS example_id, c_mktsegment IN ('BUILDING', 'MACHINERY') AS ordered,
        c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
        OR c_custkey NOT IN (SELECT example_id FROM bad) AS matched
    FROM customer""")
def _e06_mixed(t):
    """Order counts only where the statement asks for it; as multisets all
    results here agree."""
    statements = t["customer"].select(
        F.col("c_custkey").alias("example_id"), F.expr(_ORDER_TEXT).alias("sql")
    )
    return cmp.match_results(cmp.flag_ordered(statements).drop("sql"), _customer_results(t))


@query("e07_score", """
    WITH p AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1 - user_id ELSE user_id END AS user_id, event_type,
                      cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM events),
    v AS (SELECT user_id, event_type, sum(k) % 2 = 0 AS matched FROM p GROUP BY ALL)
    SELECT event_id, event_type AS predictor, c_mktsegment AS category,
        CASE WHEN c_custkey IS NULL THEN 'no example with this id'
             WHEN user_id % 11 = 0 THEN 'predictor error: timeout'
             WHEN c_custkey % 13 = 0 THEN 'rejected unsafe SQL: SQL must start with SELECT or WITH, got: ''DELETE FROM t'''
             WHEN user_id % 17 = 0 THEN 'rejected unsafe SQL: SQL contains a forbidden write/DDL keyword: "SELECT ''drop''"'
             WHEN k > 90 THEN 'execution error: no such column: x' END AS exec_error,
        coalesce(c_custkey IS NOT NULL AND user_id % 11 <> 0 AND c_custkey % 13 <> 0 AND user_id % 17 <> 0
                 AND (k > 90) IS NOT TRUE AND matched, false) AS correct
    FROM p LEFT JOIN customer ON c_custkey = user_id LEFT JOIN v USING (user_id, event_type)""")
def _e07(t):
    """Every seventh prediction has an id that no example has; it stays."""
    examples = t["customer"].select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("question about "), "c_name").alias("question"),
        F.col("c_mktsegment").alias("category"),
        F.when(F.col("c_custkey") % 13 == 0, "DELETE FROM t").otherwise("SELECT 1").alias("sql"),
    )
    k = F.get_json_object("props", "$.k").cast("bigint")
    known = F.when(F.col("event_id") % 7 == 0, -1 - F.col("user_id")).otherwise(F.col("user_id"))
    predictions = t["events"].withColumn("k", k).select(
        known.alias("id"), F.col("event_type").alias("predictor"), "event_id",
        F.when(F.col("user_id") % 17 == 0, "SELECT 'drop'").otherwise("SELECT 2").alias("sql"),
        F.when(F.col("user_id") % 11 == 0, "timeout").otherwise("").alias("error"),
        F.when(F.col("k") > 90, "no such column: x").alias("run_error"),
        "k",
    )
    verdicts = predictions.groupBy("id", "predictor").agg((F.sum("k") % 2 == 0).alias("matched"))
    result = sc.score(examples, predictions.drop("k"), verdicts)
    return result.select("event_id", "predictor", "category", "exec_error", "correct")


@query("e08_accuracy", f"""
    WITH {SQL_SCORED} SELECT avg(correct::int::double) AS accuracy FROM scored""")
def _e08(t):
    return sc.accuracy(scored(t))


@query("e09_accuracy_by_category", f"""
    WITH {SQL_SCORED} SELECT predictor, category, avg(correct::int::double) AS accuracy
    FROM scored GROUP BY ALL ORDER BY ALL""")
def _e09(t):
    return sc.accuracy_by_category(scored(t), ("predictor",))


_SQL_LATENCY = f"""latency AS (
    SELECT predictor, max(latency_ms) FILTER (i = n // 2) AS p50,
           max(latency_ms) FILTER (i = least(n - 1, cast(floor(n * 0.95) AS bigint))) AS p95,
           {sql_round('avg(latency_ms)', 6)} AS mean
    FROM (SELECT predictor, latency_ms, count(*) OVER (PARTITION BY predictor) AS n,
                 row_number() OVER (PARTITION BY predictor ORDER BY latency_ms) - 1 AS i FROM scored)
    GROUP BY predictor)"""


@query("e10_latency_stats", f"WITH {SQL_SCORED}, {_SQL_LATENCY} SELECT * FROM latency")
def _e10(t):
    return rounded(sc.latency_stats(scored(t), ("predictor",)), only=["mean"])


@query("e10_latency_stats_overall", f"""
    WITH {SQL_SCORED}, r AS (SELECT latency_ms, count(*) OVER () AS n,
        row_number() OVER (ORDER BY latency_ms) - 1 AS i FROM scored)
    SELECT max(latency_ms) FILTER (i = n // 2) AS p50,
           max(latency_ms) FILTER (i = least(n - 1, cast(floor(n * 0.95) AS bigint))) AS p95,
           {sql_round('avg(latency_ms)', 6)} AS mean FROM r""")
def _e10_all(t):
    return rounded(sc.latency_stats(scored(t)), only=["mean"])


@query("e11_total_cost", f"""
    WITH {SQL_SCORED} SELECT predictor, {sql_round('sum(cost_usd)', 9)} AS total_cost_usd
    FROM scored GROUP BY predictor""")
def _e11(t):
    return rounded(sc.total_cost(scored(t), ("predictor",)), 9)


@query("e12_cost_per_1k", f"""
    WITH {SQL_SCORED} SELECT predictor, {sql_round('sum(cost_usd) / count(*) * 1000', 6)} AS cost_per_1k_usd
    FROM scored GROUP BY predictor""")
def _e12(t):
    return rounded(sc.cost_per_1k(scored(t), ("predictor",)), 6)


@query("e13_failures", f"""
    WITH {SQL_SCORED} SELECT predictor, id, question, category, gold_sql, sql AS pred_sql, exec_error
    FROM scored WHERE NOT correct""")
def _e13(t):
    return sc.failures(scored(t))


@query("e14_report", f"""
    WITH {SQL_SCORED}, {_SQL_LATENCY},
    sums AS (SELECT predictor, avg(correct::int::double) AS accuracy, count(*) AS n,
        {sql_round('sum(cost_usd)', 9)} AS total_cost_usd,
        {sql_round('sum(cost_usd) / count(*) * 1000', 6)} AS cost_per_1k_usd,
        count(*) FILTER (NOT correct) AS n_failures FROM scored GROUP BY predictor),
    cats AS (SELECT predictor, category, avg(correct::int::double) AS category_accuracy
             FROM scored GROUP BY ALL)
    SELECT * FROM sums JOIN latency USING (predictor) JOIN cats USING (predictor)""")
def _e14(t):
    """The report, its map turned back into rows for the comparison."""
    flat = sc.report(scored(t)).select(
        "predictor", "accuracy", "n", F.round("total_cost_usd", 9).alias("total_cost_usd"),
        F.round("cost_per_1k_usd", 6).alias("cost_per_1k_usd"), "n_failures",
        "latency_ms.p50", "latency_ms.p95", F.round("latency_ms.mean", 6).alias("mean"),
        F.explode("accuracy_by_category").alias("category", "category_accuracy"),
    )
    return flat


@query("e15_token_cost", f"""
    WITH x AS (SELECT event_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM events)
    SELECT event_id, CASE event_type WHEN 'view' THEN {sql_round('k / 1e6 * 1.0 + 3 * k / 1e6 * 5.0', 9)}
        WHEN 'click' THEN {sql_round('k / 1e6 * 3.0 + 3 * k / 1e6 * 15.0', 9)} END AS cost_usd FROM x""")
def _e15(t):
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    used = t["events"].select(
        "event_id", F.col("event_type").alias("model"), tokens.alias("input_tokens"),
        (tokens * 3).alias("output_tokens"),
    )
    prices = t.spark.createDataFrame(
        [("view", 1.0, 5.0), ("click", 3.0, 15.0)], "model string, price_in double, price_out double"
    )
    return rounded(sc.token_cost(used, prices).select("event_id", "cost_usd"), 9)


@query("e16_leaderboard", f"""
    WITH {SQL_SCORED}, {_SQL_LATENCY},
    sums AS (SELECT predictor, avg(correct::int::double) AS acc, count(*) AS n,
        sum(cost_usd) / count(*) * 1000 AS c FROM scored GROUP BY predictor)
    SELECT predictor, printf('%.1f%%', acc * 100) AS accuracy, n, printf('%.0f', p50) AS p50_ms,
           printf('%.0f', p95) AS p95_ms, printf('$%.4f', c) AS cost_per_1k
    FROM sums JOIN latency USING (predictor)""")
def _e16(t):
    return rep.leaderboard(sc.report(scored(t)))


@query("e17_category_matrix", f"""
    WITH {SQL_SCORED}, y AS (SELECT predictor, correct,
            CASE WHEN category = 'c3' AND predictor = 'view' THEN 'c3 of view' ELSE category END AS category FROM scored),
    x AS (SELECT category, predictor, avg(correct::int::double) AS a FROM y GROUP BY ALL)
    SELECT category, """ + ", ".join(f"max(a) FILTER (predictor = '{p}') AS {p}" for p in PREDICTORS)
    + " FROM x GROUP BY category")
def _e17(t):
    """Categories that only some predictors met: empty cells, not zeros."""
    own = (F.col("category") == "c3") & (F.col("predictor") == "view")
    rows = scored(t).withColumn("category", F.when(own, "c3 of view").otherwise(F.col("category")))
    return rep.category_matrix(sc.category_maps(rows), PREDICTORS)


_SQL_TOP_FAILURES = f"""
    WITH {SQL_SCORED} SELECT predictor, id, category, exec_error, rn::integer AS place, n AS total,
        greatest(n - 10, 0) AS remaining
    FROM (SELECT *, row_number() OVER (PARTITION BY predictor ORDER BY id) AS rn,
                 count(*) OVER (PARTITION BY predictor) AS n FROM scored WHERE NOT correct)
    WHERE rn <= 10"""


@query("e18_top_failures", _SQL_TOP_FAILURES)
def _e18(t):
    top = rep.top_failures(sc.failures(scored(t)), 10)
    return top.select("predictor", "id", "category", "exec_error", "place", "total", "remaining")


@query("e19_preview", """
    WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn,
        count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT o_custkey AS example_id, (rn - 1)::integer AS place, 'n:' || o_orderkey * 100 || '|s:' || o_orderstatus AS cells,
           n AS result_row_count, n > 6 AS result_truncated
    FROM r WHERE rn <= 6""")
def _e19(t):
    results = cmp.result_rows(
        t["orders"], "o_custkey", "gold", ["o_orderkey", "o_orderstatus"], "o_orderkey"
    )
    shown = rep.preview(results, 6)
    flat = shown.select("example_id", "result_row_count", "result_truncated",
                        F.posexplode("result_rows").alias("place", "row"))
    return flat.select("example_id", "place", F.array_join("row", "|").alias("cells"),
                       "result_row_count", "result_truncated")


# Three predictors answer a question about the orders of each customer: one
# returns the expected rows, one returns them the other way round, one is wrong.
@query("e_evaluate_run", """
    WITH g AS (SELECT c_custkey, c_mktsegment, c_mktsegment IN ('BUILDING', 'MACHINERY') AS ordered,
                      count(o_orderkey) AS n, max(o_orderkey) AS top
               FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
    SELECT predictor, c_mktsegment AS category, count(*) AS n, avg(CASE predictor
            WHEN 'echo' THEN 1 WHEN 'wrong' THEN 0
            ELSE (NOT ordered OR n = 0 OR (n = 1 AND top = 0))::integer END) AS accuracy
    FROM g, (VALUES ('echo'), ('reversed'), ('wrong')) p(predictor) GROUP BY ALL""")
def _evaluate(t):
    examples = t["customer"].select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("Orders of "), "c_name").alias("question"),
        F.col("c_mktsegment").alias("category"), F.expr(_ORDER_TEXT).alias("sql"),
    )
    names = F.explode(F.array(*[F.lit(n) for n in ("echo", "reversed", "wrong")]))
    nothing = F.lit(None).cast("string")
    predictions = examples.select(
        "id", "sql", names.alias("predictor"), nothing.alias("error"), nothing.alias("run_error")
    )
    orders = t["orders"].select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"),
                                cmp.pack_cells(t["orders"], ["o_totalprice"]).alias("cells"))
    zero = examples.select(F.lit("wrong").alias("predictor"), "id", F.lit(0).cast("bigint").alias("pos"),
                           F.array(F.lit("n:0")).alias("cells"))
    predicted = (
        orders.withColumn("predictor", F.lit("echo"))
        .unionByName(orders.withColumn("pos", -F.col("pos")).withColumn("predictor", F.lit("reversed")))
        .unionByName(zero)
    )
    result = evaluate(examples, predictions, orders, predicted)
    return result.groupBy("predictor", "category").agg(
        F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy")
    )


# A whole run: the predictors above, with latencies, token prices (none for
# "wrong"), answers that failed and statements that failed.
_SQL_RUN = """g AS (SELECT c_custkey, c_mktsegment, c_mktsegment IN ('BUILDING', 'MACHINERY') AS ordered,
                      count(o_orderkey) AS n, max(o_orderkey) AS top
               FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
    answers AS (SELECT *, CASE WHEN predictor = 'echo' AND c_custkey % 50 = 0 THEN 'predictor error: timeout'
            WHEN predictor = 'reversed' AND c_custkey % 60 = 1 THEN 'execution error: no such column: x' END AS exec_error,
        (c_custkey * 37 + length(predictor)) % 1009 + 0.25 AS latency_ms,
        CASE predictor WHEN 'echo' THEN c_custkey % 100 / 1e6 * 1.013 + c_custkey % 7 / 1e6 * 5.07
            WHEN 'reversed' THEN c_custkey % 100 / 1e6 * 3.013 + c_custkey % 7 / 1e6 * 15.07 END AS cost_usd
        FROM g, (VALUES ('echo'), ('reversed'), ('wrong')) p(predictor)),
    run AS (SELECT *, exec_error IS NULL AND CASE predictor WHEN 'echo' THEN true WHEN 'wrong' THEN false
            ELSE NOT ordered OR n = 0 OR (n = 1 AND top = 0) END AS correct FROM answers)"""


def _run(t) -> tuple[DataFrame, DataFrame]:
    """(scored answers, predicted rows) of that run."""
    examples = t["customer"].select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("Orders of "), "c_name").alias("question"),
        F.col("c_mktsegment").alias("category"), F.expr(_ORDER_TEXT).alias("sql"),
    )
    key, predictor = F.col("id"), F.col("predictor")
    names = F.explode(F.array(*[F.lit(n) for n in ("echo", "reversed", "wrong")]))
    used = examples.select(
        "id", "sql", names.alias("predictor"), (key % 100).alias("input_tokens"), (key % 7).alias("output_tokens")
    ).withColumn("model", predictor)
    prices = t.spark.createDataFrame([("echo", 1.013, 5.07), ("reversed", 3.013, 15.07)], "model string, price_in double, price_out double")
    predictions = sc.token_cost(used, prices).select(
        "id", "predictor", "sql", ((key * 37 + F.length("predictor")) % 1009 + 0.25).alias("latency_ms"), "cost_usd",
        F.when((predictor == "echo") & (key % 50 == 0), "timeout").alias("error"),
        F.when((predictor == "reversed") & (key % 60 == 1), "no such column: x").alias("run_error"),
    )
    orders = t["orders"].select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"),
                                cmp.pack_cells(t["orders"], ["o_totalprice"]).alias("cells"))
    zero = examples.select(F.lit("wrong").alias("predictor"), "id", F.lit(0).cast("bigint").alias("pos"),
                           F.array(F.lit("n:0")).alias("cells"))
    predicted = (
        orders.withColumn("predictor", F.lit("echo"))
        .unionByName(orders.withColumn("pos", -F.col("pos")).withColumn("predictor", F.lit("reversed")))
        .unionByName(zero)
    )
    return evaluate(examples, predictions, orders, predicted), predicted


@query("e_run_from_files", f"""
    WITH {_SQL_RUN}, marks AS (
        SELECT predictor, max(latency_ms) FILTER (i = n // 2) AS p50,
               max(latency_ms) FILTER (i = least(n - 1, cast(floor(n * 0.95) AS bigint))) AS p95
        FROM (SELECT predictor, latency_ms, count(*) OVER (PARTITION BY predictor) AS n,
                     row_number() OVER (PARTITION BY predictor ORDER BY latency_ms) - 1 AS i FROM run) GROUP BY predictor),
    sums AS (SELECT predictor, avg(correct::int) AS accuracy, count(*) AS n, sum(cost_usd) / count(*) * 1000 AS cost
             FROM run GROUP BY predictor),
    board AS (SELECT 'leaderboard' AS part, predictor, '' AS item, printf('%.1f%%', accuracy * 100) || '|' || n || '|'
            || printf('%.0f', p50) || '|' || printf('%.0f', p95) || '|'
            || coalesce(printf('$%.4f', cost), 'n/a (no cost data)') AS shown FROM sums JOIN marks USING (predictor)),
    matrix AS (SELECT 'matrix' AS part, predictor, c_mktsegment AS item, printf('%.1f%%', avg(correct::int) * 100) AS shown
               FROM run GROUP BY ALL),
    failed AS (SELECT predictor, c_custkey::varchar AS id, coalesce(exec_error, '') AS shown,
                      row_number() OVER (PARTITION BY predictor ORDER BY c_custkey::varchar) AS place,
                      count(*) OVER (PARTITION BY predictor) AS n FROM run WHERE NOT correct)
    SELECT * FROM board UNION ALL SELECT * FROM matrix
    UNION ALL SELECT 'failure', predictor, id, shown || '|' || greatest(n - 10, 0) FROM failed WHERE place <= 10""")
def _run_files(t):
    """From predictions to files, and from the files the leaderboard, the matrix
    and the first failures, one line each."""
    folder = scratch_path(t.spark, "runs")
    runs.write_run(_run(t)[0], folder, "first")
    run = runs.read_run(t.spark, folder, "first")
    lit, join = F.lit, F.concat_ws
    board = rep.leaderboard(run.reports).select(
        lit("leaderboard").alias("part"), "predictor", lit("").alias("item"),
        join("|", "accuracy", F.col("n").cast("string"), "p50_ms", "p95_ms", "cost_per_1k").alias("shown"),
    )
    matrix = rep.category_matrix(run.reports, ["echo", "reversed", "wrong"])
    cells = matrix.select("category", F.explode(F.create_map(*[x for p in ("echo", "reversed", "wrong") for x in (lit(p), F.col(p))])).alias("predictor", "a"))
    matrix = cells.where("a IS NOT NULL").select(lit("matrix").alias("part"), "predictor", F.col("category").alias("item"), percent("a").alias("shown"))
    first = rep.top_failures(run.failures).select(
        lit("failure").alias("part"), "predictor", F.col("id").alias("item"),
        join("|", F.coalesce("exec_error", lit("")), F.col("remaining").cast("string")).alias("shown"),
    )
    return board.unionByName(matrix).unionByName(first)


@query("e_recorded_run", f"""
    WITH {_SQL_RUN}, shown AS (
        SELECT 'echo' AS predictor, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders
        UNION ALL SELECT 'reversed', o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY -o_orderkey) FROM orders
        UNION ALL SELECT 'wrong', c_custkey, 0, 1 FROM customer),
    sizes AS (SELECT predictor, o_custkey, count(*) AS rows_, string_agg('n:' || cast(round_even(o_totalprice * 100, 0) AS bigint), '|' ORDER BY place)
            FILTER (place <= 6) AS head FROM shown GROUP BY ALL)
    SELECT c_custkey AS id, run.predictor, c_mktsegment AS category, round(latency_ms, 1) AS latency_ms, correct,
        CASE WHEN exec_error IS NULL THEN coalesce(head, '') ELSE '' END AS head,
        CASE WHEN exec_error IS NULL THEN coalesce(rows_, 0) ELSE 0 END AS result_row_count,
        exec_error IS NULL AND coalesce(rows_, 0) > 6 AS result_truncated, exec_error AS error
    FROM run LEFT JOIN sizes ON o_custkey = c_custkey AND sizes.predictor = run.predictor""")
def _recorded(t):
    """Every scored answer with the head of its result."""
    scored_rows, predicted = _run(t)
    head = F.array_join(F.transform("result_rows", lambda r: r[0]), "|").alias("head")
    return rep.recorded_run(scored_rows, predicted).select(
        "id", "predictor", "category", "latency_ms", "correct", head, "result_row_count", "result_truncated", "error")
