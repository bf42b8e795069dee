"""What several operators share: word expressions, staged tables, running totals, worker state."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, as Java regular expressions.
BLANKS = r"[\x20\x09-\x0D]+"
NON_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null gives an empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column, separators: str) -> Column:
    """The words of a text as an array; none for null or a text of separators only."""
    trimmed = F.split(F.coalesce(text, F.lit("")), separators)
    return F.filter(trimmed, lambda w: w != F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only if none is set and all runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it back: the lineage is cut, a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """One object for each Python worker process, kept between its tasks: tokenizers and their caches."""
    store = sys.__dict__.setdefault("_minutewise_per_worker", {})
    if name not in store:
        store[name] = make()
    return store[name]


def running_totals(df: DataFrame, order: list[str], weights: dict[str, str], name: str) -> tuple[DataFrame, dict[str, int]]:
    """Adds `<out>` = the sum of column `weights[out]` over all rows before this one in the order of `order`.

    Rows are range-partitioned and sorted once; each partition adds up its own rows and the partitions' totals
    (one row a partition, so bounded by their number) are added up on the driver. Also returns the grand totals.
    Rows that are equal in all of `order` are interchangeable. `order` should end in columns that tell rows apart,
    so that no key is too frequent for one partition.
    """
    spark = df.sparkSession
    add = T.StructType([T.StructField("part", T.IntegerType()), *(T.StructField(w, T.LongType()) for w in weights)])
    schema = T.StructType([*df.schema.fields, *add.fields])
    columns = list(weights.items())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = dict.fromkeys(weights, 0)
        for b in batches:
            made = [pa.array([part] * b.num_rows, pa.int32())]
            for out, of in columns:
                value = b.column(of).cast(pa.int64())
                upto = pc.add(pc.cumulative_sum(value), before[out])
                made.append(pc.subtract(upto, value))
                if b.num_rows:
                    before[out] = upto[-1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=schema.fieldNames())

    rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(local, schema), name)
    totals = rows.groupBy("part").agg(*(F.sum(of).alias(out) for out, of in columns)).orderBy("part").collect()
    sums, starts = dict.fromkeys(weights, 0), []
    for t in totals:
        starts.append((t["part"], *(sums[w] for w in weights)))
        for w in weights:
            sums[w] += t[w]
    first = spark.createDataFrame(starts, T.StructType([add.fields[0], *(T.StructField(f"{w}_first", T.LongType()) for w in weights)]))
    out = rows.join(F.broadcast(first), "part")
    return out.withColumns({w: F.col(w) + F.col(f"{w}_first") for w in weights}).drop("part", *(f"{w}_first" for w in weights)), sums
