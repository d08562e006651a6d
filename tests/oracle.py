"""Run catalog queries next to their SQL in DuckDB and compare all values.

    python tests/oracle.py [-s 0.01] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyframe.sources.tables import SCHEMAS  # noqa: E402

DATA = os.environ.get("TALLYFRAME_TESTDATA", "/root/testdata")


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (bool, int)):
        return float(value)
    return value


def rows(columns, records) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in records)


def compare(name, entry, spark, con, folder) -> tuple[str, int, float]:
    """('' or the difference, rows, seconds)."""
    start = time.time()
    df = entry(spark, folder)
    got = rows(df.columns, df.collect())
    took = time.time() - start
    n = sum(got.values())
    if entry.sql is None:
        return "", n, took
    cursor = con.execute(entry.sql)
    names = [d[0] for d in cursor.description]
    want = rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", n, took
    if got != want:
        only_got = list((got - want).items())[:2]
        only_want = list((want - got).items())[:2]
        return (
            f"rows {n} / {sum(want.values())}; spark only {str(only_got)[:400]}; "
            f"sql only {str(only_want)[:400]}", n, took,
        )
    return "", n, took


def main() -> None:
    from conftest import session

    args = sys.argv[1:]
    sf = args.pop(args.index("-s") + 1) if "-s" in args else "0.01"
    prefixes = tuple(a for a in args if a != "-s")
    from tallyframe.plans.catalog import CATALOG

    folder = f"{DATA}/sf{sf}"
    spark, con = session(), duck(folder)
    bad = []
    for name, entry in CATALOG.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            problem, n, took = compare(name, entry, spark, con, folder)
        except Exception as error:  # report and go on
            problem, n, took = f"{type(error).__name__}: {str(error)[:700]}", -1, 0.0
        print(f"{'ok ' if not problem else 'BAD'} {name:45s} {n:7d} rows {took:6.2f}s "
              f"{'' if entry.sql else '(rows only) '}{problem}", flush=True)
        if problem or n <= 0:
            bad.append(name)
    print("bad or empty:", bad)


if __name__ == "__main__":
    main()
