"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import chat, divergence, graph_index, infill, oracle, reachable, tokens
from tallyframe.llm.decontamination import contamination
from tallyframe.llm.html_text import extracted
from tallyframe.llm.near_dup import near_duplicates
from tallyframe.llm.packing import packed
from tallyframe.llm.pii import personal_data
from tallyframe.llm.quality_model import quality_scores
from tallyframe.llm.quality_rules import PRIOR, quality_rules
from tallyframe.llm.repeats import without_repeats
from tallyframe.llm.token_files import token_files
from tallyframe.sources import tables as sources
from tallyframe.sources.tables import Tables


def load_tables(spark: SparkSession, folder: str) -> Tables:
    return sources.load_tables(reachable(spark), folder)


def op1_llr_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    tables = load_tables(spark, folder)
    return quality_rules(tables["documents"], tables["labels"].where("quality = 1"), prior=PRIOR)


def op2_suffix_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    tables = load_tables(spark, folder)
    return contamination(tables["documents"], tables["benchmark"]).drop("matches")


def op3_bootstrapped_pii(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(load_tables(spark, folder)["documents"])


def op4_zstd_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(load_tables(spark, folder)["documents"], tokens.vocabulary_path())


def op5_circulant_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(load_tables(spark, folder)["documents"])


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(load_tables(spark, folder)["documents"], tokens.vocabulary_path()).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def op7_composite_density_html(spark: SparkSession, folder: str) -> DataFrame:
    return extracted(load_tables(spark, folder)["pages"])


def op8_ftrl_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    tables = load_tables(spark, folder)
    return quality_scores(tables["documents"], tables["labels"])


def op9_prefix_free_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(load_tables(spark, folder)["documents"]).drop("spans")


def op10_round_trip_chat(spark: SparkSession, folder: str) -> DataFrame:
    table = load_tables(spark, folder)["conversations"].select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -1L AS conv_id, t AS turn, if(t = 0, 'user', 'assistant') AS role, :said AS text FROM VALUES (0L), (1L) AS v(t)", args={"said": said})
    return chat.read_back(chat.formatted_turns(table.unionByName(extra)))


def op11_divergence_trees(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(load_tables(spark, folder)["documents"])


def op12_pruned_graph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return graph_index.neighbours(load_tables(spark, folder)["embeddings"])


def op13_chunked_infill(spark: SparkSession, folder: str) -> DataFrame:
    made = infill.infilled(load_tables(spark, folder)["documents"])
    back = infill.restored(F.col("form"), F.col("output"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_llr_quality_rules,
        op2_suffix_decontamination, op3_bootstrapped_pii, op4_zstd_token_files,
        op5_circulant_near_dup, op6_best_fit_packing, op7_composite_density_html, op8_ftrl_quality_model, op9_prefix_free_repeats,
        op10_round_trip_chat, op11_divergence_trees, op12_pruned_graph_neighbours, op13_chunked_infill,
    )
}
SQL: dict[str, str] = {
    "op2_suffix_decontamination": oracle.DECONTAMINATION,
    "op5_circulant_near_dup": oracle.NEAR_DUPLICATES,
    "op9_prefix_free_repeats": oracle.REPEATS,
    "op10_round_trip_chat": oracle.CHAT,
    "op11_divergence_trees": oracle.DIVERGENCE,
    "op13_chunked_infill": oracle.INFILL,
}
