"""A corpus from raw documents to packed sequences, in five stages, each one operator over all that the last one kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps. All but the last
return the columns of documents; each result is written as Parquet and read again as the next stage's documents.

Defined results: null and empty texts fail the quality rules, so they go in the first stage; null languages are a stratum
of their own; of rows that share a doc_id and are near duplicates one stays, those
without an id all stay in near-dedup; columns beyond those of
documents, whatever their names, come along up to packing; labels and items that are null or have no id decide nothing;
ties (copies) keep the smallest doc_id; texts of any length are worked through whole; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from minutewise.llm.decontaminate import drop_contaminated
from minutewise.llm.near_dups import drop_near_duplicates
from minutewise.llm.packing import packing_query
from minutewise.llm.quality_rules import keep_good
from minutewise.llm.queries import documents, vocabulary
from minutewise.llm.secret_scan import redact
from minutewise.llm.shared import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return drop_near_duplicates(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return redact(docs, vocabulary=vocabulary("word_bpe_49k.json"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    return packing_query(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("packing", packing),
]

#: Certified cutoffs, transitive links and packing have no whole SQL twin; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
