"""Token ids in Parquet files: list columns in ascending doc_id order, read selectively.

The documents are range-partitioned and sorted by doc_id, encoded where they lie and written once. Row groups and pages
are kept small (`ROW_GROUP` bytes, `PAGE_ROWS` rows), so that the page indexes, which Parquet's writer adds, let a
reader skip to a range of documents; ids are dictionary-encoded while a page's dictionary lasts, doc_id and the counts
stand in columns of their own and are read without the ids. Each file's rows count their tokens from the start of their
part; `parts` beside the files holds the first token of each part, a row a part.

Defined results: a null or empty text has the end id only; repeated rows are written one by one; extra columns are
ignored; an empty table gives an empty file set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutewise.llm.shared import new_path, per_worker
from minutewise.llm.token_counts import slices
from minutewise.llm.token_ids import PieceEncoder

END = 2
ROW_GROUP = 16 << 20
PAGE_ROWS = 2_000
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
OPTIONS = {
    "parquet.block.size": ROW_GROUP,
    "parquet.page.row.count.limit": PAGE_ROWS,
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "PARQUET_2_0",
    "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = END) -> None:
    """Writes `path`/tokens and `path`/parts."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(f"ids {vocabulary}", lambda: PieceEncoder(vocabulary))
        part, upto = TaskContext.get().partitionId(), 0
        for b in batches:
            for s in slices(b):
                ids = encoder.encode(s.column("text"))
                n = np.fromiter((len(x) + 1 for x in ids), np.int64, len(ids))
                offsets = np.r_[0, np.cumsum(n)]
                flat = np.full(offsets[-1], end, np.int32)
                for x, at in zip(ids, offsets[:-1].tolist(), strict=True):
                    flat[at : at + len(x)] = x
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [s.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(upto + offsets[:-1]), pa.array(n), lists], names=["doc_id", "part", "start_in_part", "n_tokens", "ids"]
                )
                upto += int(offsets[-1])

    spark = docs.sparkSession
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Nothing but texts and ids moves; long keys are told apart by the text's checksum.
    ordered = small.withColumn("tie", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(encoded, SCHEMA).write.options(**OPTIONS).parquet(f"{path}/tokens")
    # A row a part, from the count columns alone.
    totals = spark.read.schema(SCHEMA).parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    firsts, upto = [], 0
    for t in totals:
        firsts.append((t["part"], upto))
        upto += t["n"]
    spark.createDataFrame(firsts, "part int, first long").coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. Columns that aren't selected are not read."""
    parts = spark.read.schema("part int, first long").parquet(f"{path}/parts")
    tokens = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    # A row a part: its size is bounded by the number of the writer's tasks.
    return tokens.join(F.broadcast(parts), "part").select("doc_id", (F.col("first") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def token_range(spark: SparkSession, path: str, first_doc: int, last_doc: int) -> DataFrame:
    """The tokens of documents first_doc to last_doc; the page indexes let Spark skip the other pages."""
    return read_tokens(spark, path).where(F.col("doc_id").between(first_doc, last_doc))


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the ids as little-endian unsigned 32-bit integers."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            flat = lists.flatten().to_numpy().astype("<u4")
            ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())].tolist()
            crc = [zlib.crc32(flat[a:z].data) for a, z in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(summed, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_query(docs: DataFrame, vocabulary: str) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "token_files")
    write_tokens(docs, path, vocabulary)
    return checksums(read_tokens(spark, path))
