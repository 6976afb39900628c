"""Token usage by user and day."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usage_today(users: DataFrame, usage: DataFrame, day: Column) -> DataFrame:
    """email, tokens_consumed: the day's tokens of every user, 0 when none."""
    from .users import with_usage

    return with_usage(users.select("email"), usage, day)


def usage_this_month(users: DataFrame, usage: DataFrame, year: int, month: int) -> DataFrame:
    """email, tokens_consumed of the month; the range on ``date`` prunes partitions."""
    first = datetime.date(year, month, 1)
    following = datetime.date(year + month // 12, month % 12 + 1, 1)
    rows = usage.where((F.col("date") >= F.lit(first)) & (F.col("date") < F.lit(following)))
    per = rows.groupBy(F.col("user_email").alias("email")).agg(F.sum("tokens_consumed").cast("long").alias("tokens_consumed"))
    return users.select("email").join(per, "email", "left").withColumn("tokens_consumed", F.coalesce("tokens_consumed", F.lit(0).cast("long")))


def add_usage(usage: DataFrame, deltas: DataFrame, day: Column) -> DataFrame:
    """The day's rows after adding ``deltas`` (user_email, tokens): user_email, date, year, month,
    tokens_consumed. Writing them over the day's partition completes the upsert."""
    there = usage.where(F.col("date") == day).select("user_email", "tokens_consumed")
    both = there.unionByName(deltas.select("user_email", F.col("tokens").cast("long").alias("tokens_consumed")))
    out = both.groupBy("user_email").agg(F.sum("tokens_consumed").cast("long").alias("tokens_consumed")).withColumn("date", day)
    return out.select("user_email", "date", F.year("date").alias("year"), F.month("date").alias("month"), "tokens_consumed")


def tokens_by_user(items: DataFrame, column: str = "actual_tokens") -> DataFrame:
    """user_id, tokens; users with none are left out."""
    return items.groupBy("user_id").agg(F.sum(column).cast("long").alias("tokens")).where("tokens <> 0")
