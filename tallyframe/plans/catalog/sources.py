"""Sources and sinks on the star-schema tables. A query about a sink writes to
the shared folder and returns what a reader finds there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import reporting as rep
from tallyframe.operators import scoring as sc
from tallyframe.operators.calllog import stats_by_predictor
from tallyframe.plans.catalog.derived import SQL_CALLS, SQL_SCORED, calls, scored
from tallyframe.plans.catalog.registry import query, sql_round
from tallyframe.session import scratch_path, stored
from tallyframe.sources import calllog as log
from tallyframe.sources import examples as ex
from tallyframe.sources import reports as rp
from tallyframe.sources.tables import SCHEMAS, load_tables, run, save_tables, table_counts
from tallyframe.streaming.calllog import append_stream, stream_calls


@query("s01_table_scan", "SELECT * FROM orders")
def _s01(t):
    return t["orders"]


_SQL_EXAMPLES = """
    SELECT text AS question, 'SELECT ' || doc_id AS sql, lang AS category,
           CASE WHEN n_chars > 100 THEN n_chars END AS gold_row_count, printf('train-%04d', doc_id) AS id
    FROM documents"""


@query("s02_s04_examples_round_trip", _SQL_EXAMPLES)
def _s04(t):
    """Examples written as JSON lines and read back."""
    path = scratch_path(t.spark, "examples")
    ex.write_examples(
        t["documents"].select(
            F.col("text").alias("question"),
            F.concat(F.lit("SELECT "), F.col("doc_id").cast("string")).alias("sql"),
            F.col("lang").alias("category"),
            F.when(F.col("n_chars") > 100, F.col("n_chars")).alias("gold_row_count"),
            F.format_string("train-%04d", "doc_id").alias("id"),
        ),
        path,
    )
    return ex.read_examples(t.spark, path)


@query("s03_s05_reports_round_trip", f"""
    WITH {SQL_SCORED}, x AS (SELECT predictor, count(*) AS n FROM scored GROUP BY predictor)
    SELECT predictor, category, avg(correct::int::double) AS accuracy, any_value(x.n) AS n
    FROM scored JOIN x USING (predictor) GROUP BY predictor, category""")
def _s03(t):
    """Reports written, read back from their files, the map as rows."""
    path = scratch_path(t.spark, "reports")
    rp.write_report(sc.report(scored(t)), path)
    reports = rp.read_reports(t.spark, path, one_per_file=False)
    rows = rep.category_rows(reports).join(reports.select("predictor", "n"), "predictor")
    return rows.select("predictor", "category", "accuracy", "n")


@query("s03_indented_reports", f"""
    WITH {SQL_SCORED}, x AS (SELECT predictor, count(*) AS n FROM scored GROUP BY predictor),
    f AS (SELECT predictor, id, coalesce(exec_error, '') AS shown, row_number() OVER (PARTITION BY predictor ORDER BY id) AS place
          FROM scored WHERE NOT correct)
    SELECT predictor, 'category' AS part, category AS item, avg(correct::int::double)::varchar AS shown, any_value(x.n) AS n
    FROM scored JOIN x USING (predictor) GROUP BY predictor, category
    UNION ALL SELECT predictor, 'failure', id, shown, x.n FROM f JOIN x USING (predictor) WHERE place <= 10""")
def _s03_indented(t):
    """Each report an indented object in a file of its own, with its first
    failures inside; all files read at once, map and list as rows."""
    path, rows = scratch_path(t.spark, "indented"), scored(t)
    first = rep.top_failures(sc.failures(rows))
    lists = first.groupBy("predictor").agg(F.array_sort(F.collect_list(F.struct(
        "id", "question", "category", "gold_sql", "pred_sql", "exec_error"))).alias("failures"))
    rp.write_report(sc.report(rows).join(lists, "predictor", "left"), path, one_per_file=True)
    reports = rp.read_reports(t.spark, path)
    listed = rp.report_failures(reports).select("predictor", F.lit("failure").alias("part"), F.col("id").alias("item"),
                                                F.coalesce("exec_error", F.lit("")).alias("shown"))
    cells = rep.category_rows(reports).select("predictor", F.lit("category").alias("part"), F.col("category").alias("item"),
                                              F.col("accuracy").cast("string").alias("shown"))
    return cells.unionByName(listed).join(reports.select("predictor", "n"), "predictor")


@query("s05_failures_round_trip", f"""
    WITH {SQL_SCORED} SELECT predictor, id, question, category, gold_sql, sql AS pred_sql, exec_error
    FROM scored WHERE NOT correct""")
def _s05(t):
    path = scratch_path(t.spark, "failures")
    rp.write_failures(sc.failures(scored(t)), path)
    return rp.read_failures(t.spark, path)


@query("s06_save_tables", """
    SELECT 'orders' AS table_name, count(*) AS row_count, sum(o_orderkey)::bigint AS key_sum FROM orders
    UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::bigint FROM lineitem
    UNION ALL SELECT 'customer', count(*), sum(c_custkey)::bigint FROM customer""")
def _s06(t):
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey"}
    folder = scratch_path(t.spark, "tables")
    save_tables(t, folder, list(keys))
    saved = load_tables(t.spark, folder)
    parts = [
        saved[n].agg(F.count("*").alias("row_count"), F.sum(k).alias("key_sum"))
        .select(F.lit(n).alias("table_name"), "row_count", "key_sum")
        for n, k in keys.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s07_l01_append_calls", f"""
    WITH {SQL_CALLS} SELECT cast(ts AS date) AS day, predictor, count(*) AS n_calls,
        count(*) AS n_ids, {sql_round('sum(latency_ms)', 4)} AS latency_ms
    FROM calls GROUP BY ALL""")
def _s07(t):
    """Two appends, then one reader of all days."""
    path = scratch_path(t.spark, "calls")
    rows = calls(t).drop("event_id")
    early = F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")
    log.append_calls(rows.where(early), path)
    log.append_calls(rows.where(~early), path)
    return log.read_calls(t.spark, path).groupBy("day", "predictor").agg(
        F.count("*").alias("n_calls"),
        F.countDistinct("id").alias("n_ids"),
        F.round(F.sum("latency_ms"), 4).alias("latency_ms"),
    )


@query("s07_stream_calls", f"""
    WITH {SQL_CALLS} SELECT source, predictor, count(*) AS n_calls, count(error) AS n_errors
    FROM calls GROUP BY ALL""")
def _s07_stream(t):
    """Calls in four parts: a batch append, a stream, a batch append, and the
    stream started again; one reader sees every call once."""
    landing, path, progress = (scratch_path(t.spark, n) for n in ("landing", "calls", "progress"))
    rows = calls(t).withColumnRenamed("event_id", "id")

    def part(number):
        return rows.where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4)) == number)

    for number in (0, 2):
        log.append_calls(part(number), path)
        part(number + 1).write.mode("append").json(landing)
        append_stream(stream_calls(t.spark, landing), path, progress).awaitTermination()
    return log.read_calls(t.spark, path).groupBy("source", "predictor").agg(
        F.count("*").alias("n_calls"), F.count("error").alias("n_errors")
    )


_STATS = f"""count(*) AS n_calls, {sql_round('nullif(avg(latency_ms), 0)', 1)} AS avg_latency_ms,
    {sql_round('sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) / nullif(count(*), 0)', 3)} AS success_rate,
    coalesce({sql_round('sum(cost_usd)', 6)}, 0.0) AS total_cost_usd"""


@query("l03_stats_from_commits", f"""
    WITH {SQL_CALLS} SELECT coalesce(predictor, 'all') AS predictor, {_STATS}
    FROM (SELECT * REPLACE (cost_usd * 1.013 AS cost_usd) FROM calls) GROUP BY ROLLUP (predictor)""")
def _l03_commits(t):
    """Appends, one of them repeated, and a compaction; the statistics come from
    the commits, no call is read."""
    path = scratch_path(t.spark, "calls")
    rows = calls(t).drop("event_id").withColumn("cost_usd", F.col("cost_usd") * 1.013)
    for number, (first, last) in enumerate((("2000-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2100-01-01"))):
        part = rows.where((F.col("ts") >= F.lit(first).cast("timestamp_ntz")) & (F.col("ts") < F.lit(last).cast("timestamp_ntz")))
        log.append_calls(part, path, f"part-{number}")
        if number == 1:
            log.append_calls(part, path, f"part-{number}")
            log.compact_calls(t.spark, path)
    return stats_by_predictor(log.live_sums(t.spark, path), sums=True)


@query("s08_table_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in SCHEMAS))
def _s08(t):
    return table_counts(t)


@query("s09_named_parameters", """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderstatus = 'F' AND o_totalprice > 300000.5""")
def _s09(t):
    sql = """
        SELECT o_orderkey, o_totalprice FROM {orders}
        WHERE o_orderstatus = :status AND o_totalprice > :least
    """
    return run(t.spark, sql, t, status="F", least=300000.5)


@query("e_stored_scores", f"""
    WITH {SQL_SCORED} SELECT predictor, count(*) AS n, avg(correct::int::double) AS accuracy,
        count(*) FILTER (NOT correct) AS n_failures
    FROM scored GROUP BY predictor""")
def _stored(t):
    """Scores written once and read by the two branches of a report."""
    rows = stored(scored(t), "scored")
    return sc.report(rows).select("predictor", "n", "accuracy", "n_failures")
