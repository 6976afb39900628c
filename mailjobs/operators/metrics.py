"""Counts that follow the flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import over_sliding_range
from .rules import label_priorities

WORKING = ("main", "user_defined", "tasks", "done")
STAGES = ("pending", *WORKING, "failed")
DAY = 86_400_000_000


def pipeline_tokens_by_user(items: DataFrame, column: str = "estimated_tokens") -> DataFrame:
    """user_id, tokens of the items in the working queues."""
    return items.where(F.col("stage").isin(*WORKING)).groupBy("user_id").agg(F.sum(column).cast("long").alias("tokens"))


def pipeline_tokens_total(items: DataFrame, column: str = "estimated_tokens") -> DataFrame:
    return items.where(F.col("stage").isin(*WORKING)).agg(F.coalesce(F.sum(column), F.lit(0)).cast("long").alias("tokens"))


def queue_counts(items: DataFrame, recent: DataFrame) -> DataFrame:
    """One row: items by stage, pending users, in pipeline, tokens, and recently processed ids."""
    working = F.col("stage").isin(*WORKING)
    stages = [F.count_if(F.col("stage") == s).alias(s) for s in STAGES]
    pending = F.count_distinct(F.when(F.col("stage") == "pending", F.col("user_id"))).alias("pending_users")
    tokens = F.coalesce(F.sum(F.when(working, F.col("estimated_tokens"))), F.lit(0)).cast("long").alias("total_tokens")
    one = items.agg(*stages, pending, F.count_if(working).alias("in_pipeline"), tokens)
    return one.join(F.broadcast(recent.agg(F.count(F.lit(1)).alias("recently_processed"))))  # one row each


def category_summary(processed: DataFrame, rules: DataFrame) -> DataFrame:
    """category, n, priority (0 when no rule has the label)."""
    n = processed.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    known = label_priorities(rules).withColumnRenamed("mail_label", "category")
    return n.join(known, "category", "left").withColumn("priority", F.coalesce("priority", F.lit(0)))


def task_metrics(processed: DataFrame) -> DataFrame:
    size = F.coalesce(F.size("extracted_tasks"), F.lit(0))
    return processed.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_tasks"), F.count_if(size > 0).alias("n_emails"))


def processed_by_user(items: DataFrame) -> DataFrame:
    return items.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def stage_token_report(items: DataFrame) -> DataFrame:
    """stage, n, estimated (content and prompt), actual, difference."""
    estimated = F.sum(F.col("estimated_tokens") + F.col("prompt_tokens")).cast("long")
    actual = F.sum("actual_tokens").cast("long")
    return items.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), estimated.alias("estimated"), actual.alias("actual"), (actual - estimated).alias("difference"))


def scan_progress(items: DataFrame) -> DataFrame:
    """user_id, total, fetched, processed, percentage. ``items``: user_id, fetched, processed."""
    per = items.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("fetched").alias("fetched"), F.count_if("processed").alias("processed"))
    return per.withColumn("percentage", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("processed") * 100.0 / F.col("total")))


def rolling_user_count(events: DataFrame, micros: int = DAY, n: str = "n") -> DataFrame:
    """Adds rolling_count: per user the sum over the time up to each event, both ends included.
    ``events``: user_id, ts, n."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return over_sliding_range(events, "user_id", at, micros, {"rolling_count": F.sum(n)})


def rolling_rate(events: DataFrame, micros: int = 10_000_000, by: str = "user_id", n: str = "n") -> DataFrame:
    """Adds rate: growth of the cumulative count from the window's oldest point to its newest, divided
    by the seconds between them; 0 with fewer than two points or under a tenth of a second."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    point = F.when(F.col("__one").isNotNull(), F.struct("__at", "event_id", n))
    values = {"__sum": F.sum(n), "__oldest": F.min(point), "__newest": F.max("__at"), "__points": F.count("__one")}
    out = over_sliding_range(events, by, at, micros, values, {"__oldest": F.least, "__newest": F.greatest})
    seconds = (F.col("__newest") - F.col("__oldest.__at")) / 1e6
    rate = F.when((F.col("__points") < 2) | (seconds < 0.1), F.lit(0.0)).otherwise((F.col("__sum") - F.col(f"__oldest.{n}")) / seconds)
    return out.withColumn("rate", rate).drop(*values)
