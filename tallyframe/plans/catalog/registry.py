"""Registration of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyframe.session import tune
from tallyframe.sources.tables import Tables, load_tables


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(load_tables(tune(spark), sf_dir))


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a function from tables to a DataFrame under ``name``."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Entry(name, build, sql)
        return build

    return register


def sql_hash(seed: int, key: str) -> str:
    """The shuffle hash in SQL."""
    return f"md5('{seed}|' || cast({key} as varchar))"


def sql_unit(seed: int, key: str) -> str:
    """The hash in [0, 1) in SQL."""
    return f"(cast(('0x' || substr({sql_hash(seed, key)}, 1, 8)) as bigint) / 4294967296.0)"


def sql_round(expr: str, places: int = 2) -> str:
    """Half-up rounding of the shortest decimal form, as Spark rounds a double."""
    return f"cast(round(cast(cast({expr} as varchar) as decimal(38,18)), {places}) as double)"
