"""Parquet tables with declared schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Tables(Mapping):
    """Tables by name. A table is opened at its first use."""

    def __init__(self, spark: SparkSession, openers: dict[str, Callable[[], DataFrame]]):
        self.spark = spark
        self._openers = openers
        self._opened: dict[str, DataFrame] = {}

    def using(self, **roles: str | DataFrame) -> Tables:
        """The same tables, some names played by another table."""

        def opener(actor: str | DataFrame) -> Callable[[], DataFrame]:
            return (lambda: self[actor]) if isinstance(actor, str) else (lambda: actor)

        return Tables(self.spark, {**self._openers, **{r: opener(a) for r, a in roles.items()}})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self._openers[name]()
        return self._opened[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._openers)

    def __len__(self) -> int:
        return len(self._openers)


def load_tables(
    spark: SparkSession, folder: str, schemas: Mapping[str, str] = SCHEMAS, suffix: str = ".parquet"
) -> Tables:
    """Scan ``folder/<name>.parquet``. A declared schema spares the job that
    would read file footers to infer one."""

    def opener(name: str, schema: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.schema(schema).parquet(f"{folder}/{name}{suffix}")

    return Tables(spark, {n: opener(n, s) for n, s in schemas.items()})


def save_tables(tables: Mapping[str, DataFrame], folder: str, names: list[str] | None = None) -> None:
    for name in names if names is not None else tables:
        tables[name].write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def table_counts(tables: Mapping[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """(table_name, row_count) of each table, answered from parquet footers."""

    def one(name: str) -> DataFrame:
        return tables[name].agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )

    chosen = names if names is not None else list(tables)
    return reduce(DataFrame.unionByName, [one(n) for n in chosen])


def run(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame] | None = None, **params) -> DataFrame:
    """Run a statement with values for its ``:name`` markers. Tables come in as
    ``{name}``; nothing is registered in the session."""
    used = {n: tables[n] for n in tables or () if f"{{{n}}}" in sql}
    return spark.sql(sql, args=params, **used)
