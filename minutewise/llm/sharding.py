"""Contiguous shards of nearly equal bytes, by global prefix sums.

Law `bytes`: documents stand in ascending order of doc_id (nulls first, ties by checksum and size); each partition adds
up its own sizes, the partitions' totals are added up once, and a document goes to the shard in whose equal share of
all bytes its middle lies. A shard's size differs from the target by less than the largest document.

Defined results: a null text has no bytes and checksum 0; empty tables give empty results; repeated rows are placed one
by one; extra columns are ignored. Texts never move: only id, size and checksum are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutewise.llm.shared import running_totals, staged


def assign_shards(docs: DataFrame, n_shards: int = 8, also: str | None = None) -> DataFrame:
    """Returns doc_id, size, text_crc32, start (bytes before it), shard, slot (place in its shard). also: a column that comes along."""
    text = F.coalesce("text", F.lit(""))
    more = [also] if also else []
    small = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(1).cast("long").alias("one"), *more)
    placed, sums = running_totals(small, ["doc_id", "text_crc32", "size", *more], {"start": "size", "row": "one"}, "shards")
    total = max(1, sums["start"])
    shard = F.least(F.expr(f"int(((2 * start + size) * {n_shards}L) div (2L * {total}L))"), F.lit(n_shards - 1))
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # a row a shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "start", "shard", (F.col("row") - F.col("first_row")).alias("slot"), *more)


def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> str:
    """Writes the documents, all their columns, to one folder a shard (shard=0 and so on), in order within it; returns the
    name of the folders' column: `shard`, with underscores before it as long as the documents have such a column.

    Rows are told apart by a number of their own, written with them first, so that repeated and null ids stay as they are.
    """
    folder = "shard"
    while folder in {c.lower() for c in docs.columns}:
        folder = f"_{folder}"
    numbered = docs.select(F.struct("*").alias("_doc")).withColumn("_row", F.monotonically_increasing_id())
    rows = staged(numbered, "numbered")
    placed = assign_shards(rows.select("_row", "_doc.doc_id", "_doc.text"), n_shards, "_row").select("_row", "shard", "slot")
    laid = rows.join(placed, "_row").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    laid.select("_doc.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
    return folder


def shards_query(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    return assign_shards(docs, n_shards).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})

