"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from minutewise.llm.alignment import alignment_query
from minutewise.llm.decontaminate import DECONTAMINATION_SQL, decontamination_query
from minutewise.llm.html_main import main_text_query
from minutewise.llm.license_scan import licenses_query
from minutewise.llm.mixing import MIXING_SQL, mixing_query
from minutewise.llm.near_dups import NEAR_DUPLICATES_SQL, near_duplicates_query
from minutewise.llm.packing import packing_query
from minutewise.llm.quality_rules import QUALITY_SQL, quality_query
from minutewise.llm.secret_scan import secrets_query
from minutewise.llm.sharding import shards_query
from minutewise.llm.token_counts import token_counts_query
from minutewise.llm.token_files import token_files_query
from minutewise.llm.whitening import whitening_query


def vocabulary(name: str) -> str:
    """Where an installed public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Tables of no more rows may lie in a single row group, which one task reads: their rows are dealt out to all cores first.
SMALL = 10_240


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, whole; one of a few rows (counted from the files' footers) is spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if df.count() <= SMALL else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts_query(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_query(documents(spark, sf_dir))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses_query(documents(spark, sf_dir))


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates_query(documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files_query(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_query(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_query(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text_query(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_query(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_query(documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_query(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_shards, op3_licenses, op4_near_dups, op5_token_files, op6_packing, op7_secrets, op8_quality, op9_main_text, op10_decontamination, op11_whitening, op12_mixing, op13_alignment,
    )
}
SQL: dict[str, str] = {"op4_near_dups": NEAR_DUPLICATES_SQL, "op8_quality": QUALITY_SQL, "op10_decontamination": DECONTAMINATION_SQL, "op12_mixing": MIXING_SQL}
