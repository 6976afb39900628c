"""Tables: reading, rule configuration, insert-ignore and updates by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import TABLES


def read_tables(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The library's tables, one parquet folder each, with their fixed schemas."""
    return {name: spark.read.schema(TABLES[name]).parquet(f"{path}/{name}") for name in names or TABLES}


def read_jdbc(spark: SparkSession, url: str, table: str, partition_col: str, bounds: tuple[int, int], partitions: int = 16, **options: str) -> DataFrame:
    """A database table read in ranges of an integer column, so that tasks share the work."""
    low, high = bounds
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=partition_col, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions), **options)
    return reader.load()


def load_rule_config(spark: SparkSession, config: dict[str, list[tuple[str, int]]]) -> DataFrame:
    """label -> [(semantic_key, priority)] as rule rows, in the order given."""
    rows = [(k + 1, key, label, False, priority) for k, (label, key, priority) in enumerate((label, key, priority) for label, keys in config.items() for key, priority in keys)]
    return spark.createDataFrame(rows, "id int, semantic_key string, mail_label string, extract_tasks boolean, priority int")


def first_of(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row of each key: the first in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def insert_ignore(new: DataFrame, existing: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The rows to append: those whose key is absent; of equal keys the first in order."""
    return first_of(new, [key], *order).join(existing.select(key), key, "left_anti")


def update_by_key(df: DataFrame, keys: DataFrame, on: list[str], column: str, value: Column, now: Column, stamp: str = "updated_at") -> DataFrame:
    """Sets a column for the rows named by ``keys``; the stamp moves only where the value changed."""
    hit = keys.select(*on).distinct().withColumn("__hit", F.lit(True))
    joined = df.join(hit, on, "left")
    new = F.when(F.col("__hit"), value).otherwise(F.col(column))
    moved = ~new.eqNullSafe(F.col(column))
    return joined.withColumn(stamp, F.when(moved, now).otherwise(F.col(stamp))).withColumn(column, new).drop("__hit").select(*df.columns)
