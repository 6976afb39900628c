"""Upserts into parquet tables: rows lie in folders by a hash of their key, and only those folders that a change
touches are read and rewritten.

A change is computed and kept before anything is overwritten, and each folder is replaced as a whole (dynamic
partition overwrite). A run that ends in between leaves some folders new and some old; running the same change
again completes it, since each of them leaves a row that has it as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import computed_once
from .tables import insert_ignore, update_by_key

BUCKET = "bucket"


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Adds the folder of each row: a number below ``buckets``, which stays the same for a table."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def create(df: DataFrame, path: str, keys: list[str], buckets: int, *by: str) -> None:
    """Writes a table in folders by ``by`` and the keys' buckets."""
    rows = bucketed(df, keys, buckets)
    rows.repartition(*by, BUCKET).write.partitionBy(*by, BUCKET).parquet(path)


def touched(table: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of the folders that ``changes`` (with their bucket) fall into: the list of these is no longer
    than the number of buckets, and Spark reads no other folder."""
    hit = sorted(r[0] for r in changes.select(BUCKET).distinct().collect())
    return table.where(F.col(BUCKET).isin(hit))


def rewrite(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], buckets: int, merge: Callable[[DataFrame, DataFrame], DataFrame], *by: str, where: Column | None = None) -> None:
    """Replaces the touched folders by what ``merge`` makes of their rows and the changes; ``where`` is a
    further condition on ``by`` for the rows that are read."""
    changes = computed_once(bucketed(changes, keys, buckets))
    table = spark.read.parquet(path)
    there = touched(table if where is None else table.where(where), changes)
    merged = computed_once(bucketed(merge(there.drop(BUCKET), changes.drop(BUCKET)), keys, buckets).select(*table.columns))
    if merged.isEmpty():
        return
    merged.repartition(*by, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, BUCKET).parquet(path)


def append_new(spark: SparkSession, path: str, new: DataFrame, key: str, buckets: int, *order: str | Column) -> None:
    """Insert-ignore into a table: appends rows whose key is absent; of equal keys the first in order. Nothing
    is rewritten, and only the keys of touched folders are read."""
    rows = computed_once(bucketed(new, [key], buckets))
    there = touched(spark.read.parquet(path), rows).select(key)
    rows = computed_once(insert_ignore(rows, there, key, *order))
    rows.write.mode("append").partitionBy(BUCKET).parquet(path)


def update_rows(spark: SparkSession, path: str, hits: DataFrame, keys: list[str], buckets: int, column: str, value: Column, now: Column, stamp: str = "updated_at") -> None:
    """Sets a column of the rows named by ``hits``; the stamp moves only where the value changed, so the same
    change again leaves everything as it is."""
    rewrite(spark, path, hits.select(*keys).distinct(), keys, buckets, lambda rows, some: update_by_key(rows, some, keys, column, value, now, stamp))


def add_tokens(spark: SparkSession, path: str, deltas: DataFrame, day: Column, batch_id: int, buckets: int) -> None:
    """Adds ``deltas`` (user_email, tokens) to a table user_email, tokens_consumed, batch_id, date, in folders by
    date and bucket. A row that has been through this batch, or a later one, takes nothing again."""

    def merge(rows: DataFrame, some: DataFrame) -> DataFrame:
        total = some.groupBy("user_email").agg(F.sum("tokens").cast("long").alias("__tokens"))
        both = rows.join(total, "user_email", "full_outer")
        due = F.coalesce(F.col("batch_id"), F.lit(-1)) < batch_id
        added = F.coalesce("tokens_consumed", F.lit(0)) + F.when(due, F.coalesce("__tokens", F.lit(0))).otherwise(0)
        seen = F.when(F.col("__tokens").isNotNull() & due, F.lit(batch_id).cast("long")).otherwise(F.col("batch_id"))
        return both.select("user_email", added.cast("long").alias("tokens_consumed"), seen.alias("batch_id"), day.alias("date"))

    rewrite(spark, path, deltas.select("user_email", "tokens"), ["user_email"], buckets, merge, "date", where=F.col("date") == day)
