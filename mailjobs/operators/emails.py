"""Processed emails: which are new, cleanups, and joining results back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def existing_ids(ids: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows of (user_id, id) that are stored for that user."""
    return ids.join(processed.select("user_id", "id"), ["user_id", "id"], "left_semi")


def unprocessed_ids(ids: DataFrame, processed: DataFrame) -> DataFrame:
    return ids.join(processed.select("user_id", "id"), ["user_id", "id"], "left_anti")


def active_cleanup_settings(settings: DataFrame, users: DataFrame) -> DataFrame:
    active = users.where("subscription_status = 'ACTIVE'").select(F.col("id").alias("user_id"))
    return settings.join(active, "user_id", "left_semi")


def cleanup_candidates(emails: DataFrame, settings: DataFrame, now: Column) -> DataFrame:
    """id, user_id, mail_label, cleanup_action of emails past their setting's age: an equi-join on
    user and label, with the age as a further condition."""
    e = emails.select("id", "user_id", F.col("category").alias("mail_label"), "processed_at")
    age = F.make_dt_interval(F.col("after_days_old"))
    old = e.join(settings.select("user_id", "mail_label", "after_days_old", "cleanup_action"), ["user_id", "mail_label"]).where(F.col("processed_at") < now - age)
    return old.select("id", "user_id", "mail_label", "cleanup_action")


def cleanup_plan(candidates: DataFrame, keep: DataFrame) -> DataFrame:
    """The actions to take: candidates that aren't kept and whose setting asks for one."""
    return candidates.where("cleanup_action <> 'NOTHING'").join(keep.select("user_id", "id"), ["user_id", "id"], "left_anti").select("id", "user_id", "mail_label", "cleanup_action")


def emails_needing_tasks(emails: DataFrame, results: DataFrame) -> DataFrame:
    """Emails whose matched rule extracts tasks (results: id, extract_tasks)."""
    return emails.join(results.where("extract_tasks").select("id"), "id", "left_semi")


def attach_results(items: DataFrame, results: DataFrame, tasks: DataFrame, key: str = "custom_id") -> DataFrame:
    """Items with their category results (those without are dropped) and tasks (none: empty)."""
    none = F.array().cast(tasks.schema["tasks"].dataType)
    return items.join(results, key).join(tasks.select(key, "tasks"), key, "left").withColumn("tasks", F.coalesce("tasks", none))


def emails_by_user(processed: DataFrame, user_id: int) -> DataFrame:
    return processed.where(F.col("user_id") == user_id)


def lookback_filter(df: DataFrame, now_ms: Column, days: int) -> DataFrame:
    """Messages newer than now less so many days; a plain comparison, so it reaches the scan."""
    return df.where(F.col("internal_date") >= now_ms - F.lit(days * 86_400_000).cast("long"))
