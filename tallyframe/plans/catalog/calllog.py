"""Call log statistics on the events as calls."""

from __future__ import annotations

from tallyframe.operators import calllog as log
from tallyframe.plans.catalog.derived import SQL_CALLS, calls
from tallyframe.plans.catalog.registry import query, sql_round

_STATS = f"""count(*) AS n_calls, {sql_round('nullif(avg(latency_ms), 0)', 1)} AS avg_latency_ms,
    {sql_round('sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) / nullif(count(*), 0)', 3)} AS success_rate,
    coalesce({sql_round('sum(cost_usd)', 6)}, 0.0) AS total_cost_usd"""


@query("l02_stats_of_one", f"""
    WITH {SQL_CALLS} SELECT 'view' AS predictor, {_STATS} FROM calls WHERE predictor = 'view'""")
def _l02(t):
    return log.stats(calls(t), "view")


@query("l02_stats_of_all", f"WITH {SQL_CALLS} SELECT 'all' AS predictor, {_STATS} FROM calls")
def _l02_all(t):
    return log.stats(calls(t), "")


@query("l02_stats_of_none", f"""
    WITH {SQL_CALLS} SELECT 'nobody' AS predictor, {_STATS} FROM calls WHERE predictor = 'nobody'""")
def _l02_none(t):
    return log.stats(calls(t), "nobody")


@query("l03_stats_by_predictor", f"""
    WITH {SQL_CALLS} SELECT coalesce(predictor, 'all') AS predictor, {_STATS}
    FROM calls GROUP BY ROLLUP (predictor)""")
def _l03(t):
    return log.stats_by_predictor(calls(t))
