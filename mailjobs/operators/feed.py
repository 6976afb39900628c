"""The feed: urgency scores, ranking and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK, DAY = 7 * 86_400_000_000, 86_400_000_000
PAGE, LARGEST_PAGE = 20, 100


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def priority_score(now: Column) -> Column:
    """The score of a row with due_date, tasks_done, is_read, has_new_reply, user_priority and
    system_priority (either may be null). Rounded half up before it becomes an integer."""
    ahead = _micros(F.col("due_date")) - _micros(now)
    due = (
        F.when(F.col("due_date").isNull() | F.col("tasks_done"), F.lit(0.0))
        .when(ahead >= WEEK, F.lit(200.0))
        .when(ahead >= 0, 300.0 - ahead / F.lit(float(DAY)) * 100 / 7)
        .when(ahead >= -WEEK, F.lit(300.0))
        .otherwise(F.lit(0.0))
    )
    read = F.when(F.col("is_read"), -90).otherwise(0)
    reply = F.when(F.col("has_new_reply"), 200).otherwise(0)
    return F.floor(due + read + reply + F.coalesce("user_priority", "system_priority", F.lit(2)) * 100 + 0.5).cast("int")


def rank_feed(emails: DataFrame, user_rules: DataFrame, system_rules: DataFrame, now: Column) -> DataFrame:
    """All columns of ``emails``, priority and priority_score. Rules are joined on their keys."""
    own = user_rules.select("user_id", F.col("semantic_key").alias("ai_answer"), F.col("mail_label").alias("category"), F.col("priority").alias("user_priority"))
    system = system_rules.select(F.col("semantic_key").alias("ai_answer"), F.col("mail_label").alias("category"), F.col("priority").alias("system_priority"))
    joined = emails.join(own, ["user_id", "ai_answer", "category"], "left").join(system, ["ai_answer", "category"], "left")
    scored = joined.withColumn("priority_score", priority_score(now)).withColumn("priority", F.coalesce("user_priority", "system_priority"))
    return scored.select(*emails.columns, "priority", "priority_score")


ORDER = (F.desc, "priority_score"), (F.desc, "history_id")


def _order() -> list[Column]:
    return [f(c) for f, c in ORDER]


def feed_page(ranked: DataFrame, user_id: int, cursor: tuple[int, int] | None = None, limit: int = PAGE) -> DataFrame:
    """One page and one row more (it tells that there is a next page). ``cursor`` is the score and
    history_id of the last row seen."""
    rows = ranked.where(F.col("user_id") == user_id)
    if cursor:
        score, history = cursor
        rows = rows.where((F.col("priority_score") < score) | ((F.col("priority_score") == score) & (F.col("history_id") < history)))
    return rows.orderBy(*_order()).limit(min(limit, LARGEST_PAGE) + 1)


def feed_all_users(ranked: DataFrame, k: int = PAGE) -> DataFrame:
    """The first page of every mailbox, with ``position``. Spark keeps k rows of a user in each task
    before it shuffles, so a huge mailbox doesn't meet in one task whole."""
    w = Window.partitionBy("user_id").orderBy(*_order(), "id")
    return ranked.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
