"""Quality rules in Spark's own functions: text counts and a log-likelihood ratio.

Words and pairs of words are hashed into ``buckets`` multinomial cells. The
cells are counted over all documents (the raw corpus) and over the trusted
documents (the target). A document's score is the mean, over its own words and
pairs, of log p_target(cell) - log p_raw(cell); a fixed threshold on it decides
every document. Cell weights are whole steps of 1 / ``SCALE``, so sums are exact
in any order. Only the ``buckets`` weights ever reach the driver.

With a ``prior``, as the query and the stage have it, every distinct text counts
once, however often it is repeated, and the target is smoothed towards the raw
share: log((t + prior) / (r T / R + prior)). A cell that few texts have tends to
0, so a clean text scores about 0 whether or not it is among the trusted ones.
Without it the target gets one count in each cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import stored

BUCKETS = 1 << 16
SCALE = 4096
# Between clean documents (about 0) and documents of a small second population.
THRESHOLD = -0.1
# From labelled rows held out of the target (README): with less, more good ones
# fall below the threshold in small corpora, with more, bad ones rise above it.
PRIOR = 6.0
_SPACE = r"[\x20\x09-\x0D]+"


def _once(column: Column) -> Column:
    """The same values, but never moved into another expression: a filter that
    is pushed down would else compute the array again for each of its elements."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _SPACE), "")


def _cells(buckets: int) -> Column:
    """The cells of the words and of the pairs of words of column ``words``."""
    single = F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pair = F.transform(
        F.sequence(F.lit(0), F.size("words") - 2),
        lambda i: F.pmod(F.xxhash64(F.get("words", i), F.get("words", i + 1)), F.lit(buckets)).cast("int"),
    )
    return F.concat(single, F.when(F.size("words") >= 2, pair).otherwise(F.array().cast("array<int>")))


def _told(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(text, trusted) of every row of ``docs``."""
    marks = trusted.where("doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(1))
    # Labels grow with the corpus: one way to join them at every size.
    return docs.select("doc_id", "text").join(marks.hint("merge"), "doc_id", "left").select(
        "text", F.coalesce("trusted", F.lit(0)).alias("trusted")
    )


def _told_once(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(text, trusted) of every distinct text; trusted if one of its rows is.

    Only hashes of texts meet the labels. Copies are merged before the shuffle.
    """
    key = [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")]
    marks = trusted.where("doc_id is not null").select("doc_id").distinct()
    told = docs.select("doc_id", *key).join(marks.hint("merge"), "doc_id", "left_semi")
    told = told.groupBy("h", "g").agg(F.lit(1).alias("trusted"))
    texts = docs.where("text is not null").select("text", *key).groupBy("h", "g").agg(F.first("text").alias("text"))
    return texts.join(told.hint("merge"), ["h", "g"], "left").select("text", F.coalesce("trusted", F.lit(0)).alias("trusted"))


def cell_weights(
    docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, scale: int = SCALE, smooth: float = 1.0, prior: float | None = None,
) -> list[int]:
    """round(scale * log(p_target / p_raw)) by cell; at most ``buckets`` numbers.
    With ``prior`` over distinct texts and smoothed towards raw, else over rows
    with ``smooth`` in each cell.

    Without trusted documents every weight is 0.
    """
    told = _told(docs, trusted) if prior is None else _told_once(docs, trusted)
    counts = (
        told.select(_once(_words("text")).alias("words"), "trusted")
        .select(F.explode(_cells(buckets)).alias("cell"), "trusted")
        .groupBy("cell").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
        .collect()
    )
    raw, target = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r["cell"]], target[r["cell"]] = r["raw"], r["target"]
    if not any(target):
        return [0] * buckets
    if prior is not None:
        share = sum(target) / sum(raw)
        return [round(scale * math.log((t + prior) / (r * share + prior))) for r, t in zip(raw, target, strict=True)]
    of_raw, of_target = sum(raw) + smooth * buckets, sum(target) + smooth * buckets
    return [
        round(scale * (math.log((t + smooth) / of_target) - math.log((r + smooth) / of_raw)))
        for r, t in zip(raw, target, strict=True)
    ]


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with words, n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words of column text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.struct(
            F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("p")
        ),
    ))
    same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    return (
        docs.withColumn("words", _once(_words("text"))).withColumn("lines", lines)
        .withColumn("n_words", F.size("words").cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("bigint"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"))
        .drop("lines")
        .withColumn("windows", _once(F.when(F.size("words") >= 3, windows)))
        .withColumn("again", _once(F.sort_array(F.transform(
            F.filter("windows", lambda x, i: same(x, F.get("windows", i - 1)) | same(x, F.get("windows", i + 1))),
            lambda x: x["p"],
        ))))
        # A window covers three words, fewer where the next repeated one begins earlier.
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(
            F.transform("again", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("again", i + 1) - p, F.lit(3)))),
            F.lit(0).cast("bigint"), lambda a, x: a + x,
        ), F.lit(0).cast("bigint")))
        .drop("windows", "again")
    )


def quality_rules(
    docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, min_words: int = 50,
    max_repeat_percent: int = 50, buckets: int = BUCKETS, scale: int = SCALE, prior: float | None = None,
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, llr) of every row of ``docs`` (doc_id, text); ``trusted``
    holds the doc_ids of the target.

    A null, empty or blank text has no words: it fails and is not kept. Repeated
    rows are judged alike, one by one. A null doc_id is never trusted. With no
    trusted document every llr is 0. An empty table gives an empty result; other
    columns are ignored. Windows of three words are compared by 64-bit hash.
    """
    return _judged(docs.select("doc_id", "text"), trusted, threshold, min_words, max_repeat_percent, buckets, scale, prior).drop("row")


def _judged(
    docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, min_words: int = 50,
    max_repeat_percent: int = 50, buckets: int = BUCKETS, scale: int = SCALE, prior: float | None = None,
) -> DataFrame:
    """The columns of ``quality_rules``, and ``row``: all columns of ``docs``."""
    weights = cell_weights(docs, trusted, buckets, scale, prior=prior)
    table = F.from_json(F.lit("[" + ",".join(map(str, weights)) + "]"), "array<int>")
    scored = text_counts(docs.select(F.struct("*").alias("row"), "doc_id", "text")).withColumn("cells", _once(_cells(buckets))).withColumn(
        "total", F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, c: a + F.get(table, c))
    )
    return scored.select(
        "row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))).alias("base_failed"),
        (F.col("total") / F.greatest(F.size("cells"), F.lit(1)) / scale).alias("llr"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def acceptable(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, each judged by its own text: a
    refused row takes no other row along, whatever their doc_ids."""
    return _judged(docs, trusted, prior=PRIOR).where("kept").select("row.*")
