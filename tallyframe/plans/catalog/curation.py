"""Curation of labelled examples on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import curation as c
from tallyframe.operators import positions as p
from tallyframe.plans.catalog.registry import query, sql_hash
from tallyframe.plans.dataset import build_examples
from tallyframe.plans.lifted import gold_rows
from tallyframe.plans.shop import shop_view

_COLUMNS = [
    ("nation", "n_name"), ("customer", "c_mktsegment"), ("orders", "o_orderstatus"),
    ("orders", "o_orderpriority"), ("part", "p_type"), ("part", "p_brand"),
    ("events", "event_type"), ("documents", "lang"), ("documents", "source"),
]


@query("d01_domains", " UNION ALL ".join(
    f"SELECT DISTINCT '{t}' AS \"table\", '{col}' AS \"column\", {col} AS value FROM {t}"
    for t, col in _COLUMNS))
def _d01(t):
    return c.domains(t, _COLUMNS)


# Question templates over the star schema. The domain names the column whose
# values fill the marker.
_TEMPLATES = [
    ("T1", "simple_filter", "n_name",
     ["Which customers live in {n_name}?", "Name all customers of {n_name}."],
     "SELECT c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = '{n_name}'"),
    ("T2", "simple_filter", "o_orderstatus",
     ["How many orders are in state {o_orderstatus}?"],
     "SELECT count(*) FROM orders WHERE o_orderstatus = '{o_orderstatus}'"),
    ("T3", "aggregation", "c_mktsegment",
     ["What do customers in {c_mktsegment} own on average?",
      "Give the mean balance of the {c_mktsegment} segment.",
      "Average account balance, segment {c_mktsegment}?"],
     "SELECT avg(c_acctbal) FROM customer WHERE c_mktsegment = '{c_mktsegment}'"),
    ("T4", "join", "p_type",
     ["Who bought a part of type {p_type}?"],
     "SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey "
     "JOIN part ON p_partkey = l_partkey WHERE p_type = '{p_type}'"),
    ("T5", "join", "p_brand",
     ["How often was {p_brand} sold?", "Sales of {p_brand} by month?"],
     "SELECT count(*) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = '{p_brand}'"),
    ("T6", "top_n", None,
     ["Which five parts cost most?", "The five dearest parts?"],
     "SELECT p_name FROM part ORDER BY p_retailprice DESC LIMIT 5"),
]
_DOMAIN_COLUMNS = [x for x in _COLUMNS if x[1] in {d for _, _, d, _, _ in _TEMPLATES}]


def _templates(t) -> DataFrame:
    return t.spark.createDataFrame(
        [(i, cat, phr, sql, dom) for i, cat, dom, phr, sql in _TEMPLATES],
        "template_id string, category string, phrasings array<string>, sql string, domain string",
    )


def _params(t) -> DataFrame:
    values = c.domains(t, _DOMAIN_COLUMNS)
    return values.select(F.col("column").alias("domain"), "value")


def _expanded(t) -> DataFrame:
    return c.expand_templates(_templates(t), _params(t))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SQL_TEMPLATES = "templates(template_id, category, domain, phrasing, sql) AS (VALUES " + ", ".join(
    f"({_text(i)}, {_text(cat)}, {_text(dom) if dom else 'NULL'}, {_text(phr)}, {_text(sql)})"
    for i, cat, dom, phrs, sql in _TEMPLATES for phr in phrs) + ")"
_SQL_PARAMS = "params AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{col}' AS domain, {col} AS value FROM {t}" for t, col in _DOMAIN_COLUMNS) + ")"
_SQL_EXPANDED = f"""{_SQL_TEMPLATES}, {_SQL_PARAMS}, expanded AS (
    SELECT template_id, category, value,
           coalesce(replace(phrasing, '{{' || domain || '}}', value), phrasing) AS question,
           coalesce(replace(sql, '{{' || domain || '}}', value), sql) AS sql
    FROM templates LEFT JOIN params USING (domain))"""


@query("d02_expand_templates", f"WITH {_SQL_EXPANDED} SELECT * FROM expanded")
def _d02(t):
    return _expanded(t)


@query("d03_lifted_counts", """
    SELECT n_name AS value, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey
        AND c_mktsegment = 'MACHINERY' AND c_acctbal > 9500) AS gold_row_count
    FROM nation""")
def _d03(t):
    """One count per nation; a nation without such customers counts zero."""
    fact = t["customer"].where((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") > 9500))
    params = t["nation"].select(F.col("n_name").alias("value"), "n_nationkey")
    return c.lifted_counts(params, fact, {"n_nationkey": "c_nationkey"}).drop("n_nationkey")


@query("d03_lifted_counts_two_keys", """
    SELECT event_type AS value, user_id AS user, count(*) AS gold_row_count
    FROM events WHERE value > 20 GROUP BY ALL
    UNION ALL
    SELECT DISTINCT event_type, user_id, 0 FROM events e WHERE NOT EXISTS (
        SELECT 1 FROM events f WHERE f.value > 20 AND f.event_type = e.event_type
        AND f.user_id = e.user_id)""")
def _d03_events(t):
    params = t["events"].select(
        F.col("event_type").alias("value"), F.col("user_id").alias("user")
    ).distinct()
    fact = t["events"].where(F.col("value") > 20)
    return c.lifted_counts(params, fact, {"value": "event_type", "user": "user_id"})


_SPACE = (r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
          r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


@query("d04_normalize_ws", rf"""
    SELECT doc_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g'), ' ') AS text FROM documents""")
def _d04(t):
    return c.normalize_ws(t["documents"].select("doc_id", "text"), "text")


@query("d05_stratified_split", f"""
    SELECT doc_id, lang, CASE WHEN rn <= greatest(1, round_even(n * 0.2::double, 0))
                              THEN 'eval' ELSE 'train' END AS split
    FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (
              PARTITION BY lang ORDER BY {sql_hash(7, 'doc_id')}, doc_id) AS rn FROM documents)""")
def _d05(t):
    return p.stratified_split(t["documents"].select("doc_id", "lang"), "lang", "doc_id", 0.2, 7)


@query("d06_seeded_shuffle", f"""
    SELECT o_orderkey, o_totalprice,
           row_number() OVER (ORDER BY {sql_hash(7, 'o_orderkey')}, o_orderkey) - 1 AS pos
    FROM orders ORDER BY pos""")
def _d06(t):
    return p.seeded_shuffle(t["orders"].select("o_orderkey", "o_totalprice"), "o_orderkey", 7)


@query("d07_assign_ids", f"""
    SELECT o_orderkey, pos, printf('train-%04d', pos) AS id FROM (SELECT o_orderkey,
        row_number() OVER (ORDER BY {sql_hash(11, 'o_orderkey')}, o_orderkey) - 1 AS pos FROM orders)""")
def _d07(t):
    return p.assign_ids(t["orders"].select("o_orderkey"), "train", "o_orderkey", 11)


@query("d08_split_summary", f"""
    SELECT source, count(*) FILTER (rn > k) AS train, count(*) FILTER (rn <= k) AS eval
    FROM (SELECT source, rn, greatest(1, round_even(n * 0.2::double, 0)) AS k FROM (
        SELECT source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (
            PARTITION BY source ORDER BY {sql_hash(7, 'doc_id')}, doc_id) AS rn FROM documents))
    GROUP BY source""")
def _d08(t):
    parts = p.stratified_split(t["documents"].select("doc_id", "source"), "source", "doc_id", 0.2, 7)
    return p.split_summary(parts, "source")


@query("d09_to_messages", """
    WITH x AS (SELECT conv_id, turn, text AS question,
                      CASE WHEN role = 'user' THEN 'SELECT ' || turn END AS sql FROM conversations)
    SELECT conv_id, turn, 0 AS pos, 'system' AS role, 'Answer with SQL.' AS content FROM x
    UNION ALL SELECT conv_id, turn, 1, 'user', question FROM x
    UNION ALL SELECT conv_id, turn, 2, 'assistant', sql FROM x WHERE sql IS NOT NULL""")
def _d09(t):
    sql = F.when(F.col("role") == "user", F.concat(F.lit("SELECT "), F.col("turn").cast("string")))
    turns = t["conversations"].select("conv_id", "turn", F.col("text").alias("question"), sql.alias("sql"))
    built = c.to_messages(turns, "Answer with SQL.")
    return built.select("conv_id", "turn", F.posexplode("messages").alias("pos", "m")).select(
        "conv_id", "turn", "pos", "m.role", "m.content"
    )


def _tokens(t) -> DataFrame:
    """Word lengths stand in for token ids; the first ``turn`` + 3 of them are
    the prompt."""
    words = F.transform(F.split("text", " "), lambda w: F.length(w))
    return t["conversations"].select(
        "conv_id", "turn", words.alias("full_ids"),
        F.slice(words, 1, (F.col("turn") + 3).cast("int")).alias("prompt_ids"),
    )


_SQL_TOKENS = """tokens AS (
    SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS full_ids,
           least(turn + 3, len(string_split(text, ' ')), {0}) AS n_prompt FROM conversations),
  cut AS (SELECT conv_id, turn, full_ids[1:{0}] AS ids, n_prompt FROM tokens),
  masked AS (SELECT conv_id, turn, ids, list_transform(range(1, len(ids) + 1),
      lambda i: CASE WHEN i <= n_prompt THEN -100 ELSE ids[i] END) AS labels FROM cut)"""


def _shown(df: DataFrame, *arrays: str) -> DataFrame:
    """Arrays as text, so that any engine can compare them."""
    texts = [F.array_join(F.col(a).cast("array<string>"), ",").alias(a) for a in arrays]
    return df.select("conv_id", "turn", *texts)


@query("d10_mask_prompt", f"""
    WITH {_SQL_TOKENS.format(64)}
    SELECT conv_id, turn, array_to_string(ids, ',') AS input_ids,
           array_to_string(labels, ',') AS labels FROM masked""")
def _d10(t):
    return _shown(c.mask_prompt(_tokens(t), 64), "input_ids", "labels")


@query("d11_pad_fixed", f"""
    WITH {_SQL_TOKENS.format(64)}
    SELECT conv_id, turn,
        array_to_string(list_transform(range(1, 49), lambda i: coalesce(ids[i], 7)), ',') AS input_ids,
        array_to_string(list_transform(range(1, 49), lambda i: coalesce(labels[i], -100)), ',') AS labels,
        array_to_string(list_transform(range(1, 49),
            lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END), ',') AS attention_mask
    FROM masked""")
def _d11(t):
    padded = c.pad_fixed(c.mask_prompt(_tokens(t), 64), 48, 7)
    return _shown(padded, "input_ids", "labels", "attention_mask")


@query("d12_assign_batches", f"""
    SELECT event_id, pos, pos // 8 AS batch FROM (SELECT event_id,
        row_number() OVER (ORDER BY {sql_hash(5, 'event_id')}, event_id) - 1 AS pos FROM events)""")
def _d12(t):
    return p.assign_batches(t["events"].select("event_id"), "event_id", 8, 5)


# Template T2 counts orders, T5 sales: the row counts come from one job each.
@query("d_build_examples", f"""
    WITH {_SQL_EXPANDED},
    placed AS (SELECT *, template_id || '/' || question AS key FROM expanded),
    split AS (SELECT *, CASE WHEN rn <= greatest(1, round_even(n * 0.2::double, 0))
                             THEN 'eval' ELSE 'train' END AS split
        FROM (SELECT *, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (
            PARTITION BY category ORDER BY {sql_hash(7, 'key')}, key) AS rn FROM placed)),
    counts AS (SELECT 'T2' AS template_id, o_orderstatus AS value, count(*) AS gold_row_count
               FROM orders GROUP BY ALL
               UNION ALL SELECT 'T5', p_brand, count(l_orderkey) FROM part
               LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand)
    SELECT split, category, question, sql, gold_row_count,
        printf('%s-%04d', split, row_number() OVER (
            PARTITION BY split ORDER BY {sql_hash(8, 'key')}, key) - 1) AS id
    FROM split LEFT JOIN counts USING (template_id, value)""")
def _d_build(t):
    """Domains, templates, counts, split and ids."""
    params = _params(t)
    states = params.where(F.col("domain") == "o_orderstatus").select("value")
    brands = params.where(F.col("domain") == "p_brand").select("value")
    per_part = t["lineitem"].groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    sold = t["part"].join(per_part, "p_partkey").groupBy("p_brand").agg(
        F.sum("n").alias("gold_row_count")
    )
    orders = c.lifted_counts(states, t["orders"], {"value": "o_orderstatus"})
    sales = brands.join(sold.withColumnRenamed("p_brand", "value"), "value", "left").na.fill(0)
    counts = orders.withColumn("template_id", F.lit("T2")).unionByName(
        sales.withColumn("template_id", F.lit("T5"))
    )
    return build_examples(_templates(t), params, counts)


@query("d03_lifted_gold_rows", """
    WITH n(value, least) AS (VALUES ('5', 5), ('12', 12), ('100000', 100000)),
    counts AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT 'q03' AS template, p_type AS value, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) - 1 AS pos,
        's:' || p_name || '|n:' || cast(round_even(p_retailprice * 100, 0) AS bigint) AS cells FROM part
    UNION ALL SELECT 'q04', v, NULL, 'n:' || 100 * (SELECT count(*) FROM customer WHERE c_mktsegment = v)
        FROM (SELECT DISTINCT c_mktsegment AS v FROM customer UNION ALL SELECT 'NOWHERE')
    UNION ALL SELECT 'q16', value, row_number() OVER (PARTITION BY value ORDER BY n DESC, o_custkey) - 1, 's:' || c_name || '|n:' || n * 100
        FROM counts JOIN n ON counts.n > least JOIN customer ON c_custkey = o_custkey""")
def _d03_gold(t):
    """Expected rows of three templates for all values of their parameters."""
    shop = shop_view(t, t.spark)
    kinds = t["part"].select(F.col("p_type").alias("value")).distinct()
    tiers = t["customer"].select(F.col("c_mktsegment").alias("value")).unionByName(t.spark.sql("SELECT 'NOWHERE' AS value"))
    numbers = t.spark.sql("SELECT value FROM VALUES ('5'), ('12'), ('100000') AS v(value)")
    parts = [
        gold_rows(shop, name, values).select(F.lit(name).alias("template"), "value", "pos", F.array_join("cells", "|").alias("cells"))
        for name, values in (("q03", kinds), ("q04", tiers), ("q16", numbers))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
