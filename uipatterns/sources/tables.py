"""Reading and writing dataset parts, annotation sheets and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uipatterns.operators.splits import PARTS
from uipatterns.schema import DATASET_ROW, GOLD_COLUMNS, GOLD_ROW

CSV = {"header": "true", "multiLine": "true", "escape": '"'}


def read_split(spark: SparkSession, root: str, split: str, part: str) -> DataFrame:
    """One part of a split; a missing column is an error."""
    path = f"{root}/{split}/{part}.csv"
    header = spark.read.options(**CSV).csv(path).columns  # reads the header line only
    missing = [f.name for f in DATASET_ROW.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} is missing columns: {missing}")
    typed = {f.name: f.dataType for f in DATASET_ROW.fields}
    raw = spark.read.options(**CSV, inferSchema="false").csv(path)
    return raw.select(*[F.col(c).cast(t).alias(c) for c, t in typed.items()])


def read_parts(spark: SparkSession, root: str, split: str) -> DataFrame:
    parts = [read_split(spark, root, split, p).withColumn("part", F.lit(p)) for p in PARTS]
    return reduce(DataFrame.unionByName, parts)


def write_parts(df: DataFrame, root: str, split: str) -> None:
    for part in PARTS:
        rows = df.filter(F.col("part") == part).select([f.name for f in DATASET_ROW.fields])
        rows.write.mode("overwrite").options(header="true", escape='"').csv(f"{root}/{split}/{part}.csv")


def write_per_class(df: DataFrame, path: str) -> None:
    """One folder per primary label."""
    df.write.mode("overwrite").partitionBy("primary_label").options(header="true", escape='"').csv(path)


def write_annotation_sheet(df: DataFrame, path: str) -> None:
    df.select(GOLD_COLUMNS).write.mode("overwrite").options(header="true", escape='"').csv(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Annotated rows of a sheet."""
    return spark.read.schema(GOLD_ROW).options(**CSV, enforceSchema="false").csv(path).filter(
        F.trim(F.coalesce("gold_labels", F.lit(""))) != "")


def write_stats(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_spread(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A table whose rows are few bytes and much work each, such as pages.

    A table of fewer file splits than cores is spread out by ``key`` first.
    Large tables come in many splits and are left alone.
    """
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    # Only the scan is planned here, nothing runs.
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(2 * cores, key)
