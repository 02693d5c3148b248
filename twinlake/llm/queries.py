"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontamination, jaccard_join, licenses, lm_score, mixing, oracle, pii, quality, suffix_dedup, token_output
from .mixing_settings import BUDGET_PERCENT, DOMAINS, EPOCHS, SEED, WEIGHTS


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.table(spark, sf_dir, "documents"))


def mixing_settings() -> dict:
    """Production parameters, with the domain as a column."""
    number = F.coalesce(F.try_to_number(F.lpad(F.regexp_extract("source", "([0-9]{1,9})$", 1), 9, "0"), F.lit("000000000")), F.lit(0)).cast("long")
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (number % 3 + 1).cast("int"))
    return {"domain": domain, "weights": WEIGHTS, "budget_percent": BUDGET_PERCENT, "epochs": EPOCHS, "seed": SEED}


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(common.table(spark, sf_dir, "documents"), **mixing_settings())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_score.score(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(common.table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output.encode_to_files(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, words_held=600_000, words_kept=600_000)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(common.table(spark, sf_dir, "documents")).drop("kept")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(common.table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(common.table(spark, sf_dir, "conversations"))


def chat_planted_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10_chat_format`` on conversations in which messages quote earlier ones, as the tables hold no quotes."""
    said = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    source = said.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.min("text").alias("said"))
    before = F.when(F.col("turn") >= 2, F.col("turn") - 2).when(F.col("turn") == 1, 0)
    quoted = F.concat(F.lit("> "), F.replace("said", F.lit("\n"), F.lit("\n> ")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return chat.format_chat(said.join(source, (F.col("conv_id") == F.col("c")) & (F.col("t") == before), "left").select("conv_id", "turn", "role", F.when(F.col("said").isNull(), F.col("text")).otherwise(quoted).alias("text")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_source_mixing": op2_source_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_score": op4_lm_score,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_token_output": op7_token_output,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_chat_format": op10_chat_format,
    "pipeline": pipeline,
    "chat_planted_quotes": chat_planted_quotes,
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mixing": oracle.OP2,
    "op5_decontamination": oracle.OP5,
    "op8_suffix_dedup": oracle.OP8,
    "op9_jaccard_join": oracle.OP9,
    "op10_chat_format": oracle.OP10,
    "chat_planted_quotes": oracle.OP10_QUOTED,
}
