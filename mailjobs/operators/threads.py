"""Flags that depend on the other messages of a thread: one window for each thread, no self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _others(condition: Column) -> Column:
    """Another message of the thread meets the condition."""
    w = Window.partitionBy("thread_id")
    hit = F.coalesce(condition, F.lit(False)).cast("int")
    return F.sum(hit).over(w) - hit > 0


def _size() -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy("thread_id"))


def thread_flags(messages: DataFrame, user_email: Column) -> DataFrame:
    """Adds is_thread, has_unread_reply, user_has_replied and new_reply (both). ``messages``:
    thread_id, sender, is_unread."""
    unread, replied = _others(F.col("is_unread")), _others(F.col("sender").contains(user_email))
    out = messages.withColumns({"is_thread": _size() > 1, "has_unread_reply": unread, "user_has_replied": replied})
    return out.withColumn("new_reply", F.col("has_unread_reply") & F.col("user_has_replied"))


def has_new_reply(messages: DataFrame, user_email: Column) -> DataFrame:
    """Adds has_new_reply: the message is unread and another unread one isn't from the user."""
    foreign = _others(F.col("is_unread") & ~F.col("sender").contains(user_email))
    return messages.withColumn("has_new_reply", F.coalesce(F.col("is_unread"), F.lit(False)) & (_size() > 1) & foreign)
