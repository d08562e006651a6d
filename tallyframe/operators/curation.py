"""Build labelled example sets: value domains, template expansion, row counts,
chat messages, token records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import collapse_space, fill

IGNORED_LABEL = -100  # fixed value: label of a token that carries no loss


def domains(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """Distinct values (table, column, value) of the given columns, one scan
    per table however many of its columns are asked for."""
    wanted: dict[str, list[str]] = {}
    for table, column in columns:
        wanted.setdefault(table, []).append(column)

    def of_table(table: str, names: list[str]) -> DataFrame:
        cells = [
            F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias("value"))
            for n in names
        ]
        return (
            tables[table]
            .select(F.explode(F.array(*cells)).alias("_c"))
            .select(F.lit(table).alias("table"), "_c.column", "_c.value")
            .distinct()
        )

    return reduce(DataFrame.unionByName, [of_table(t, ns) for t, ns in wanted.items()])


def expand_templates(templates: DataFrame, params: DataFrame) -> DataFrame:
    """One row per template, parameter value and phrasing.

    ``templates``: template_id, category, phrasings (array), sql, domain (null
    for a template without a parameter). ``params``: domain, value. The marker
    to replace is the domain's name in braces; a template whose domain has no
    values gives no rows.

    Templates meet their values through the domain, so no pair is built that is
    then thrown away. The join is an inner one: there Spark may send the few
    templates to the values, or split a domain that holds most of them.
    """
    bound = templates.join(params, "domain")
    free = templates.where(F.col("domain").isNull()).withColumn("value", F.lit(None).cast("string"))
    filled = bound.unionByName(free).withColumn("phrasing", F.explode("phrasings"))
    return filled.select(
        "template_id",
        "category",
        "value",
        fill("phrasing", "domain", "value").alias("question"),
        fill("sql", "domain", "value").alias("sql"),
    )


def lifted_counts(
    params: DataFrame, fact: DataFrame, keys: dict[str, str], out: str = "gold_row_count"
) -> DataFrame:
    """Rows of ``fact`` for every parameter row in one job, zero included.

    ``keys`` maps parameter columns to fact columns. The fact side shrinks to
    one row per key before it meets the parameters.
    """
    counts = (
        fact.groupBy(*[F.col(f).alias(p) for p, f in keys.items()])
        .agg(F.count("*").alias(out))
    )
    return params.join(counts, list(keys), "left").na.fill(0, [out])


def normalize_ws(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, collapse_space(col))


def to_messages(
    df: DataFrame, system_prompt: str | Column, question: str = "question", sql: str = "sql"
) -> DataFrame:
    """Add ``messages``: system, user and, where there is SQL, assistant."""
    system = F.lit(system_prompt) if isinstance(system_prompt, str) else system_prompt

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))

    turns = F.array(
        turn("system", system), turn("user", F.col(question)), turn("assistant", F.col(sql))
    )
    kept = F.when(F.col(sql).isNull(), F.slice(turns, 1, 2)).otherwise(turns)
    return df.withColumn("messages", kept)


def _head(array: Column, n: Column | int) -> Column:
    return F.slice(array, 1, n)


def mask_prompt(
    df: DataFrame, max_len: int, full: str = "full_ids", prompt: str = "prompt_ids"
) -> DataFrame:
    """Add ``input_ids`` (cut to ``max_len``) and ``labels``, in which the
    tokens of the prompt are ignored."""
    ids = _head(F.col(full), max_len)
    n_prompt = F.least(F.size(_head(F.col(prompt), max_len)), F.size(ids))
    rest = F.slice(ids, n_prompt + 1, F.greatest(F.size(ids) - n_prompt, F.lit(0)))
    labels = F.concat(F.array_repeat(F.lit(IGNORED_LABEL), n_prompt), rest)
    return df.withColumn("labels", labels).withColumn("input_ids", ids)


def pad_fixed(df: DataFrame, length: int, pad_id: int) -> DataFrame:
    """Cut or pad ``input_ids`` and ``labels`` to one length and add
    ``attention_mask``."""
    ids, labels = _head(F.col("input_ids"), length), _head(F.col("labels"), length)
    n = F.size(ids)
    missing = F.lit(length) - n
    return df.select(
        *[c for c in df.columns if c not in ("input_ids", "labels")],
        F.concat(ids, F.array_repeat(F.lit(pad_id), missing)).alias("input_ids"),
        F.concat(labels, F.array_repeat(F.lit(IGNORED_LABEL), missing)).alias("labels"),
        F.concat(
            F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), missing)
        ).alias("attention_mask"),
    )
