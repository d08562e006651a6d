"""Exact order statistics by index, by radix selection in two reads.

A double has an integer form of 64 bits that sorts like the value. The first
read counts rows by group and the leading digit of that form; running sums tell
in which cell the wanted index lies. The second read takes the rows of these
cells only, counts them by the whole integer form, and two more digits settle
the value. Every count is pre-aggregated on the map side, so neither a group
with a third of all rows nor one value repeated a billion times reaches a single
task, and what is gathered of a group is at most 2**22 counts.

Cells are looked up by broadcasting those of the large groups: fewer than
``_MOST_LARGE`` groups can hold more than that share of the rows each. Groups
below it are counted by the integer form as they are, each a bounded share.
Nothing runs before the result is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MOST_LARGE = 50_000
_FIRST, _SECOND = 44, 22  # bits below the first and below the second digit
_TOP = 2047 * 2**52  # the integer form of infinity


def with_integer_form(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add an integer that sorts as the double does: sign, exponent and fraction,
    as in its bits. Minus zero is zero, not-a-number comes last, null is null."""
    v, size, power, scaled = F.col(value), F.col("_size"), F.col("_power"), F.col("_scaled")
    ordinary = (v != 0) & (size < float("inf"))
    # Step by step, so that no step is computed twice. The logarithm may miss by
    # one next to a power of two, which the size tells.
    steps = df.withColumn("_size", F.abs(v))
    steps = steps.withColumn("_power", F.when(ordinary, F.greatest(F.floor(F.log2(size)).cast("int"), F.lit(-1022))))
    steps = steps.withColumn("_scaled", size / F.pow(F.lit(2.0), power))
    miss = F.when(scaled >= 2, 1).when((scaled < 1) & (power > -1022), -1).otherwise(0)
    steps = steps.withColumn("_power", power + miss).withColumn("_scaled", size / F.pow(F.lit(2.0), F.col("_power")))
    # Below the smallest normal number there is no leading one.
    form = F.when(scaled >= 1, (power + 1023).cast("bigint") * F.lit(2**52) + ((scaled - 1) * F.lit(2.0**52)).cast("bigint")).otherwise(
        (scaled * F.lit(2.0**52)).cast("bigint"))
    steps = steps.withColumn("_form", F.when(ordinary, form).when(v == 0, F.lit(0).cast("bigint")).when(F.isnan(v), F.lit(_TOP + 1)).when(v.isNotNull(), F.lit(_TOP)))
    return steps.withColumn(out, F.when(v < 0, -F.col("_form")).otherwise(F.col("_form"))).drop("_size", "_power", "_scaled", "_form")


def upper_median(n: Column) -> Column:
    """Index n // 2."""
    return F.floor(n / 2)


def high_index(share: float):
    """Index int(share * n), at most n - 1."""

    def index(n: Column) -> Column:
        return F.least(n - 1, F.floor(n * F.lit(share)))

    return index


def keyed(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``df`` with the group as a struct (which groups and joins nulls), the value
    as a double, its integer form and its first digit, null where it is null."""
    # Without groups the key is still taken from the row: joins on a constant are no equi-joins.
    same = F.lit(0) if by else F.hash(value).bitwiseAND(F.lit(0))
    rows = df.withColumns({"_g": F.struct(*[F.col(c) for c in by], same.alias("_")), "_v": F.col(value).cast("double")})
    return with_integer_form(rows, "_v", "_key").withColumn("_cell", F.shiftright("_key", _FIRST))


def hit_in(counts: str, at: str) -> Column:
    """Where index ``at`` lies in an array of (k, n) sorted by k: that k and the
    rows before it."""
    return F.expr(f"""aggregate(array_sort({counts}), named_struct('before', 0L, 'k', cast(NULL AS bigint)), (a, x) -> CASE
        WHEN a.k IS NOT NULL THEN a WHEN {at} < a.before + x.n THEN named_struct('before', a.before, 'k', x.k)
        ELSE named_struct('before', a.before + x.n, 'k', a.k) END)""")


def read_once(counts: DataFrame) -> DataFrame:
    """``counts`` for several readers. The filter is always true, but it asks for
    all columns: readers of some of them then differ in nothing below it, and
    Spark runs what they share once."""
    return counts.where(F.hash(*counts.columns) >= -(2**31))


def select_at(rows: DataFrame, cells: DataFrame, picks: dict[str, object]) -> DataFrame:
    """(_g, n, a column per pick): the values at the wanted indexes of each group.

    ``rows`` come from ``keyed``, ``cells`` (_g, _cell, _n) are the counts of their
    values by first digit. ``picks`` maps a name to a function from a group's count to a
    0-based index.
    """
    cells = cells.where(F.col("_n") > 0)  # not the cell of the nulls
    share = cells.agg(F.sum("_n")).scalar() / F.lit(_MOST_LARGE)
    wanted = F.array(*[F.struct(F.lit(name).alias("pick"), index(F.col("n")).cast("bigint").alias("at")) for name, index in picks.items()])

    # One row per large group: the cells with a wanted index, and what is wanted there.
    groups = cells.groupBy("_g").agg(F.sum("_n").alias("n"), F.collect_list(F.struct(F.col("_cell").alias("k"), F.col("_n").alias("n"))).alias("_cells"))
    asked = (
        groups.where(F.col("n") > share).withColumn("w", F.explode(wanted)).withColumn("_hit", hit_in("_cells", "w.at"))
        .groupBy("_g", "n").agg(F.collect_list(F.struct(F.col("_hit.k").alias("_cell"), "w.pick", (F.col("w.at") - F.col("_hit.before")).alias("at"))).alias("_asked"))
    )
    # A row of a large group stays for the picks in its cell, any other row for all picks.
    here = F.filter("_asked", lambda a: a["_cell"] == F.col("_cell"))
    everything = F.array(F.struct(F.lit(None).cast("bigint").alias("_cell"), F.lit("").alias("pick"), F.lit(None).cast("bigint").alias("at")))
    near = (
        rows.where(F.col("_key").isNotNull()).select("_g", "_key", "_cell", "_v").join(F.broadcast(asked), "_g", "left")
        .where(F.col("_asked").isNull() | F.array_contains("_asked._cell", F.col("_cell")))
        .withColumn("a", F.explode(F.when(F.col("_asked").isNull(), everything).otherwise(here)))
    )
    group = ["_g", "_pick"]
    values = near.groupBy("_g", "n", F.coalesce("a.pick", F.lit("")).alias("_pick"), F.col("a.at").alias("_at"), "_key").agg(
        F.count("*").alias("_n"), F.max("_v").alias("_v")
    )
    # Keys that cannot be null give the join below no filter to add, so that both
    # readers of the values share one pass over the rows.
    values = read_once(values.withColumn("_sub", F.coalesce(F.shiftright("_key", _SECOND), F.lit(0))))

    subs = values.groupBy(*group, "n", "_at", "_sub").agg(F.sum("_n").alias("_n"))
    subs = subs.groupBy(*group, "_at", F.col("n").alias("_of")).agg(
        F.sum("_n").alias("_all"), F.collect_list(F.struct(F.col("_sub").alias("k"), F.col("_n").alias("n"))).alias("_subs")
    ).withColumn("n", F.coalesce("_of", "_all"))
    mine = F.filter(wanted, lambda w: (F.col("_pick") == "") | (w["pick"] == F.col("_pick")))
    found = (
        subs.withColumn("w", F.explode(mine)).withColumn("_to", F.coalesce("_at", "w.at")).withColumn("_hit", hit_in("_subs", "_to"))
        .select(*group, F.col("_hit.k").alias("_sub"), "n", F.col("w.pick").alias("_name"), (F.col("_to") - F.col("_hit.before")).alias("_k"))
    )
    last = values.drop("n", "_at").join(found, [*group, "_sub"]).groupBy("_g", "_name", "n", "_k").agg(
        F.collect_list(F.struct(F.col("_key").alias("k"), F.col("_n").alias("n"), F.col("_v").alias("v"))).alias("_keys")
    )
    hit = last.withColumn("_hit", hit_in("_keys", "_k")).select("_g", "n", "_name", F.expr("filter(_keys, x -> x.k = _hit.k)[0].v").alias("_v"))
    return hit.groupBy("_g", "n").agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in picks])


def values_at(df: DataFrame, by: list[str], value: str, picks: dict[str, object]) -> DataFrame:
    """One row per group: ``by``, ``n`` and a column per pick (see ``select_at``).
    Rows with a null value do not count; nulls in ``by`` are groups as well."""
    rows = keyed(df, by, value)
    cells = read_once(rows.groupBy("_g", "_cell").agg(F.count("_v").alias("_n")))
    return select_at(rows, cells, picks).select(*[F.col("_g")[c].alias(c) for c in by], "n", *picks)
