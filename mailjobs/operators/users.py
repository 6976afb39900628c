"""Users, their access, and their quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LONG = 2**63 - 1


def users_with_access(users: DataFrame, access: DataFrame) -> DataFrame:
    """One row for each user with an account access: the user's columns and needs_reauthentication."""
    a = access.select(F.col("user_email").alias("email"), "needs_reauthentication")
    return users.join(a, "email").select(*users.columns, "needs_reauthentication")


def users_with_access_and_usage(users: DataFrame, access: DataFrame, usage: DataFrame) -> DataFrame:
    """One row for each user and day of usage."""
    u = usage.select(F.col("user_email").alias("email"), "date", "tokens_consumed")
    return users_with_access(users, access).join(u, "email").select(*users.columns, "needs_reauthentication", "date", "tokens_consumed")


def active_users(users: DataFrame, access: DataFrame) -> DataFrame:
    return users_with_access(users, access).where("subscription_status = 'ACTIVE' and not needs_reauthentication")


def cancelled_users(users: DataFrame) -> DataFrame:
    return users.where("subscription_status = 'CANCELLED'")


def with_usage(users: DataFrame, usage: DataFrame, day: Column) -> DataFrame:
    """Adds tokens_consumed of the day, 0 where there is none. The day filter reaches the scan."""
    today = usage.where(F.col("date") == day).groupBy(F.col("user_email").alias("email")).agg(F.sum("tokens_consumed").cast("long").alias("tokens_consumed"))
    return users.join(today, "email", "left").withColumn("tokens_consumed", F.coalesce("tokens_consumed", F.lit(0).cast("long")))


def pollable_users(users: DataFrame, access: DataFrame, usage: DataFrame, day: Column) -> DataFrame:
    """Active users that have scanned once, hold a valid access and are below their limit today."""
    ready = active_users(users, access).where("is_initial_scan_complete")
    return with_usage(ready, usage, day).where("tokens_consumed < daily_token_limit")


def effective_limit(limit: Column) -> Column:
    """The limit and a twenty-fifth of it; the unlimited value stays what it is."""
    return F.coalesce(F.try_add(limit, F.floor(limit / F.lit(25).cast("decimal(20,0)")).cast("long")), F.lit(MAX_LONG))


def quota_status(users: DataFrame, pipeline_tokens: DataFrame) -> DataFrame:
    """Adds ``status``: quota, pipeline_quota or poll. ``users``: id, daily_token_limit,
    tokens_consumed. ``pipeline_tokens``: user_id, tokens."""
    inside = pipeline_tokens.select(F.col("user_id").alias("id"), F.col("tokens").alias("__t"))
    limit = effective_limit(F.col("daily_token_limit"))
    status = F.when(F.col("tokens_consumed") >= limit, "quota").when(F.col("tokens_consumed") + F.coalesce("__t", F.lit(0)) >= limit, "pipeline_quota").otherwise("poll")
    return users.join(inside, "id", "left").withColumn("status", status).drop("__t")
