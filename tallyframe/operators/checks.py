"""Table constraints as quality jobs: (rule, violations).

``check_tables`` takes the constraints of several tables and reads each table
once; the other functions check one constraint of one table.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_rule(df: DataFrame, rule: str, count: Column) -> DataFrame:
    return df.agg(F.coalesce(count, F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit(rule).alias("rule"), "violations"
    )


def check_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Count the rows that break each rule, all rules in one pass. A rule is a
    condition that is true for a bad row; null is not a violation."""
    named = [(f"_r{i}", rule, bad) for i, (rule, bad) in enumerate(rules.items())]
    sums = df.agg(*[F.count_if(bad).alias(c) for c, _, bad in named])
    pairs = [F.struct(F.lit(r).alias("rule"), F.col(c).alias("violations")) for c, r, _ in named]
    return sums.select(F.explode(F.array(*pairs)).alias("_r")).select("_r.*")


def is_missing(column: str) -> Column:
    return F.col(column).isNull()


def outside_domain(column: str, values: list) -> Column:
    return ~F.col(column).isin(values)


def outside_range(column: str, low, high) -> Column:
    return ~F.col(column).between(low, high)


def check_not_null(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    return check_rows(df, {f"{table}.{c} not null": is_missing(c) for c in columns})


def check_domain(df: DataFrame, column: str, values: list, table: str) -> DataFrame:
    return check_rows(df, {f"{table}.{column} in domain": outside_domain(column, values)})


def check_range(df: DataFrame, column: str, low, high, table: str) -> DataFrame:
    return check_rows(df, {f"{table}.{column} in range": outside_range(column, low, high)})


def check_unique(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Surplus rows per key; keys with a null part are not compared."""
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    sizes = df.where(known).groupBy(*columns).agg(F.count("*").alias("_n"))
    rule = f"{table}({', '.join(columns)}) unique"
    return _as_rule(sizes.where(F.col("_n") > 1), rule, F.sum(F.col("_n") - 1))


def check_primary_key(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Rows with a null key part plus surplus rows per key, from one grouping."""
    sizes = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    null_part = reduce(Column.__or__, [F.col(c).isNull() for c in columns])
    bad = F.when(null_part, F.col("_n")).otherwise(F.col("_n") - 1)
    return _as_rule(sizes, f"{table}({', '.join(columns)}) primary key", F.sum(bad))


def check_foreign_key(
    child: DataFrame, column: str, parent: DataFrame, key: str, table: str
) -> DataFrame:
    """Child rows whose non-null key has no parent. The child shrinks to one
    row per key first, so a key shared by many rows costs one lookup."""
    keys = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    parents = parent.select(F.col(key).alias(column))
    orphans = keys.join(parents, column, "left_anti")
    return _as_rule(orphans, f"{table}.{column} references {key}", F.sum("_n"))


@dataclass(frozen=True)
class Rules:
    """The constraints of one table. ``references`` maps a column to the table
    whose primary key, a single column, it names."""

    primary_key: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    domains: Mapping[str, list] = field(default_factory=dict)
    ranges: Mapping[str, tuple] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    references: Mapping[str, str] = field(default_factory=dict)


def _key_text(columns: tuple[str, ...]) -> Column:
    """A key as text, null if a part is null. Parts are told apart by their lengths."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    parts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[x for part in parts for x in (F.length(part).cast("string"), F.lit(":"), part)])


def check_tables(tables: Mapping[str, DataFrame], rules: Mapping[str, Rules]) -> DataFrame:
    """Count the violations of all constraints, each table read once.

    A row gives a mark for each rule on its own columns that it breaks, for each
    of its keys and for each reference. Marks are counted before the shuffle, by
    key space and key: a parent's key and all references to it meet there, and
    repeated keys show as counts above one. A key that a third of all rows name
    is one mark per map task.
    """
    spaces: list[str] = []
    slots: dict[str, int] = {}  # references of a key space so far
    found: list[tuple[str, int, str]] = []  # rule, its space and the sum that tells

    def space(name: str) -> int:
        if name not in spaces:
            spaces.append(name)
        return spaces.index(name)

    def mark(where: int, slot: int, key: Column, only: Column) -> Column:
        return F.when(only, F.struct(F.lit(where).alias("space"), F.lit(slot).alias("slot"), key.cast("string").alias("key")))

    marks = []
    for table, r in rules.items():
        own = []
        broken = {f"{table}.{c} not null": is_missing(c) for c in r.required}
        broken |= {f"{table}.{c} in domain": outside_domain(c, values) for c, values in r.domains.items()}
        broken |= {f"{table}.{c} in range": outside_range(c, *limits) for c, limits in r.ranges.items()}
        for rule, bad in broken.items():
            own.append(mark(space(rule), 0, F.lit(None), bad))
            found.append((rule, space(rule), "all_0"))
        for columns in ([r.primary_key] if r.primary_key else []) + list(r.unique):
            main = columns == r.primary_key
            rule = f"{table}({', '.join(columns)}) {'primary key' if main else 'unique'}"
            where, key = space(f"key of {table}" if main else rule), _key_text(columns)
            own.append(mark(where, -1, key, F.lit(True) if main else key.isNotNull()))
            found.append((rule, where, "surplus"))
        for column, parent in r.references.items():
            name = f"key of {parent}"
            slots[name] = slots.get(name, -1) + 1
            own.append(mark(space(name), slots[name], F.col(column), F.col(column).isNotNull()))
            found.append((f"{table}.{column} references {rules[parent].primary_key[0]}", space(name), f"lost_{slots[name]}"))
        if own:
            marks.append(tables[table].select(F.explode(F.array(*own)).alias("m")).where("m IS NOT NULL").select("m.*"))

    used = range(max([*slots.values(), 0]) + 1)
    owners = F.count_if(F.col("slot") < 0).alias("owners")
    counted = reduce(DataFrame.unionByName, marks).groupBy("space", "key").agg(owners, *[F.count_if(F.col("slot") == k).alias(f"n_{k}") for k in used])
    surplus = F.when(F.col("key").isNull(), F.col("owners")).otherwise(F.greatest(F.col("owners") - 1, F.lit(0)))
    lost = [F.sum(F.when(F.col("owners") == 0, F.col(f"n_{k}"))).alias(f"lost_{k}") for k in used]
    sums = counted.groupBy("space").agg(F.sum(surplus).alias("surplus"), F.sum("n_0").alias("all_0"), *lost)
    # A row per key space is left; every rule looks for its own.
    told = [F.coalesce(F.sum(F.when(F.col("space") == where, F.col(column))), F.lit(0)).alias(f"_{i}") for i, (_, where, column) in enumerate(found)]
    pairs = [F.struct(F.lit(rule).alias("rule"), F.col(f"_{i}").alias("violations")) for i, (rule, _, _) in enumerate(found)]
    return sums.agg(*told).select(F.explode(F.array(*pairs)).alias("_r")).select("_r.*")
