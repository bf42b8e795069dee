"""Readers and writers of fault records, metric files and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutewise.plans.schemas import FAULTS, SourceSpec, SystemSpec

DAY_FOLDER = r"/(\d\d[^/]*)/[^/]*$"


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A CSV file with a header, by column name; empty fields are null."""
    frame = spark.read.option("header", True).option("enforceSchema", False).schema(schema)
    return frame.csv(path)


def read_csv_by_name(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A CSV file whose columns stand in another order, or partly lack, than in `schema`."""
    text = spark.read.option("header", True).csv(path)
    wanted = spark.createDataFrame([], schema).schema
    return text.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in text.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))


def read_faults(spark: SparkSession, path: str, system: SystemSpec) -> DataFrame:
    """system, level, component, reason, timestamp (epoch seconds), onset (local time, no zone), day."""
    raw = read_csv(spark, path, FAULTS[system.name.lower()])
    local = F.col("timestamp") + system.utc_offset
    return (
        raw.withColumn("timestamp", F.col("timestamp").cast("long"))
        .withColumn("onset", F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, timestamp + %d)" % system.utc_offset))
        .withColumn("day", F.date_from_unix_date(F.floor(local / 86400).cast("int")))
        .select(F.lit(system.name).alias("system"), "level", "component", "reason", "timestamp", "onset", "day")
    )


def read_metrics(spark: SparkSession, root: str, spec: SourceSpec) -> DataFrame:
    """day (folder name), second (epoch), component, kpi, value of one kind of file in all day folders."""
    columns = [spec.ts_col, spec.id_col, *([spec.kpi_col, spec.val_col] if spec.kind == "long" else spec.value_cols)]
    raw = spark.read.option("header", True).csv(f"{root}/*/{spec.pattern}").select(*columns, F.regexp_extract(F.col("_metadata.file_path"), DAY_FOLDER, 1).alias("day"))
    raw = raw.where(F.col("day") != "").withColumn("second", F.floor(F.col(spec.ts_col).cast("double") / spec.ts_unit).cast("long"))
    if spec.kind == "long":
        return raw.select("day", "second", F.col(spec.id_col).alias("component"), F.col(spec.kpi_col).alias("kpi"), clean_number(spec.val_col).alias("value"))
    values = raw.select("day", "second", F.col(spec.id_col).alias("component"), *(clean_number(c).alias(c) for c in spec.value_cols))
    return values.unpivot(["day", "second", "component"], list(spec.value_cols), "kpi", "value").where("value is not null")


def clean_number(column: str):
    """A double; NaN, which pandas skips, becomes null."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def read_runs(spark: SparkSession, root: str, runs: dict[str, str], name: str, schema: str) -> DataFrame:
    """One result file of several runs (folder: label), united by name, with `run` and its order `run_order`."""
    out = None
    for i, (folder, label) in enumerate(runs.items()):
        one = read_csv_by_name(spark, f"{root}/{folder}/{name}", schema).withColumns({"run": F.lit(label), "run_order": F.lit(i)})
        out = one if out is None else out.unionByName(one)
    return out


def write_matrix(grid: DataFrame, path: str) -> None:
    """The unfiltered series as Parquet, partitioned by system and day."""
    grid.write.partitionBy("system", "day").mode("overwrite").parquet(path)


def write_result(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header; null becomes an empty field."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
