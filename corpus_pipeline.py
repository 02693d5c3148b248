"""A corpus from documents to token files: quality rules, near duplicates, decontamination, mixing, token output.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner writes it as Parquet to the shared folder and gives the next
stage what it reads back.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinlake.llm import common, decontamination, jaccard_join, mixing, quality, token_output
from twinlake.llm.queries import mixing_settings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.select(docs, **mixing_settings())


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output.encode_to_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]

#: The token ids come from a tokenizer library and the thresholds from exact binomial bounds, which SQL has not; tests hold run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = common.table(spark, sf_dir, "documents"), common.new_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(at)
        docs = spark.read.parquet(at)
    return docs
