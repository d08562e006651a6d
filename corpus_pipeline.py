"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import decontamination, near_dup, packing, pii, quality_rules, reachable, tokens
from tallyframe.session import stored
from tallyframe.sources.tables import load_tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the target are rows labelled good."""
    labels = load_tables(reachable(spark), sf_dir)["labels"]
    return quality_rules.acceptable(docs, labels.where("quality = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 85 percent of the shingles of
    five words, the threshold of op5."""
    reachable(spark)
    return near_dup.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages that count."""
    return decontamination.uncontaminated(docs, load_tables(reachable(spark), sf_dir)["benchmark"])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    reachable(spark)
    return pii.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece."""
    reachable(spark)
    return packing.packed(docs, tokens.vocabulary_path())


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii", personal_data),
    ("best_fit_packing", pack),
]

# Hashes of words, signatures and token ids are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = load_tables(spark, sf_dir)["documents"]
    for number, (name, stage) in enumerate(STAGES):
        if number:
            docs = stored(docs, f"stage-{number}")
        docs = stage(spark, docs, sf_dir)
    return docs
