"""Order and admission of work.

A mailbox may hold a large part of all rows, so positions and sums are computed in pieces of it
(``prefix``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import computed_once
from ..sources.tables import first_of
from .emails import lookback_filter, unprocessed_ids
from .prefix import in_pieces, numbered, running_sum, summed

HIGH, LOW, BACKGROUND = 0, 1, 2


def union_queues(**queues: DataFrame) -> DataFrame:
    """The items of all queues, each with the name of its queue as stage."""
    named = [items.withColumn("stage", F.lit(stage)) for stage, items in queues.items()]
    out = named[0]
    for other in named[1:]:
        out = out.unionByName(other)
    return out


def distinct_users(items: DataFrame) -> DataFrame:
    """The users of a batch of items, each once, in order."""
    return items.select("user_id").distinct().orderBy("user_id")


def latest_ids(messages: DataFrame, processed: DataFrame, now_ms: Column, days: int, n: int) -> DataFrame:
    """The n newest unprocessed ids of each user in the lookback. Spark keeps n of a user in each
    task before it shuffles."""
    fresh = unprocessed_ids(lookback_filter(messages, now_ms, days).select("user_id", "id", "internal_date"), processed)
    w = Window.partitionBy("user_id").orderBy(F.desc("internal_date"), "id")
    return fresh.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def prune_to_token_limit(emails: DataFrame, limit: int, tokens: str = "tokens", salts: int = 32) -> DataFrame:
    """Drops each user's oldest emails until the sum fits: a row stays while the sum from the newest
    down to it is within the limit. ``emails``: user_id, internal_date, arrival, tokens (not negative).

    A huge mailbox doesn't meet in one task: its salted parts first drop what lies beyond their own
    first row over the limit, which is beyond the whole mailbox's as well, and no sum that counts
    changes.
    """
    order = F.desc("internal_date"), F.desc("arrival")
    part = Window.partitionBy("user_id", "__salt").orderBy(*order)
    before = F.coalesce(F.sum(tokens).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = emails.withColumn("__salt", F.pmod(F.xxhash64("arrival"), F.lit(salts))).withColumn("__before", before).where(F.col("__before") <= limit)
    whole = Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("__sum", F.sum(tokens).over(whole)).where(F.col("__sum") <= limit).drop("__sum", "__before", "__salt")


def pruned_empty(emails: DataFrame, limit: int, tokens: str = "tokens") -> DataFrame:
    """Users that keep nothing: those whose newest email alone is over the limit."""
    newest = emails.groupBy("user_id").agg(F.max_by(tokens, F.struct("internal_date", "arrival")).alias("t"))
    return newest.where(F.col("t") > limit).select("user_id")


def round_robin(items: DataFrame, *order: str) -> DataFrame:
    """Adds ``turn``: a user's first item has turn 1, the second 2, ...; the fair order is by turn,
    then user. Neither a total order nor a user's rows meet in one task."""
    return numbered(items, ["user_id"], list(order), "turn").withColumn("turn", F.col("turn").cast("int"))


def distinct_entries(entries: DataFrame) -> DataFrame:
    """Queue entries with repeated categorization ids counted once; embeddings (background) stay."""
    ranked = entries.where(F.col("priority") < BACKGROUND)
    return first_of(ranked, ["email_id"], "arrival").unionByName(entries.where(F.col("priority") == BACKGROUND))


def task_order(entries: DataFrame) -> DataFrame:
    """Adds priority order and turns: work is taken by priority, turn, then the user's first arrival.
    ``entries``: user_id, email_id, priority, arrival."""
    rows = distinct_entries(entries)
    first = rows.groupBy("priority", "user_id").agg(F.min("arrival").alias("user_first"))
    turns = numbered(rows, ["priority", "user_id"], ["arrival"], "turn")
    return turns.withColumn("turn", F.col("turn").cast("int")).join(first, ["priority", "user_id"])


def queue_count_by_user(entries: DataFrame) -> DataFrame:
    """user_id, high, low, background, total, categorization."""
    count = lambda k: F.count_if(F.col("priority") == k)
    return entries.groupBy("user_id").agg(count(HIGH).alias("high"), count(LOW).alias("low"), count(BACKGROUND).alias("background"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("priority") < BACKGROUND).alias("categorization"))


def quota_admission(items: DataFrame, order: str) -> DataFrame:
    """The admitted items, all of one priority: in order, up to the first that finds the quota used or
    would pass it by more than a hundredth. ``items``: user_id, estimate, quota, used, and ``order``,
    distinct inside a user."""
    rows = running_sum(items, ["user_id"], [order], F.col("estimate"), "__sum", inclusive=False)
    before = F.col("used") + F.col("__sum")
    over = (before >= F.col("quota")) | (F.col("estimate") > F.col("quota") - before + F.floor(F.col("quota") / 100))
    stop = rows.where(over).groupBy(F.col("user_id").alias("__user")).agg(F.min(order).alias("__stop"))
    free = F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))
    return rows.join(stop, F.col("user_id") == F.col("__user"), "left").where(free).select(*items.columns)


def admit_mixed(items: DataFrame, order: str) -> DataFrame:
    """Admission with priorities: low ones are passed over once more than half of the quota is used, and use
    nothing. ``items``: user_id, order, estimate (not negative), quota, used, priority.

    Until the half is passed every item counts, after it only those that aren't low. So the items that count
    come from one running sum over all, what is used before each from a second one over those that count,
    and admission ends at the first of these that doesn't fit.
    """
    rows = in_pieces(items.select("user_id", order, "estimate", "quota", "used", "priority"), ["user_id"], [order])
    half = computed_once(summed(rows, ["user_id"], [order], F.col("estimate"), "__all", inclusive=False))
    counts = (F.col("used") + F.col("__all") <= F.floor(F.col("quota") / 2)) | ~F.col("priority").eqNullSafe(F.lit(LOW))
    sums = computed_once(summed(half, ["user_id"], [order], F.when(counts, F.col("estimate")).otherwise(0), "__sum", inclusive=False).where(counts))
    before = F.col("used") + F.col("__sum")
    over = (before >= F.col("quota")) | (F.col("estimate") > F.col("quota") - before + F.floor(F.col("quota") / 100))
    stop = sums.where(over).groupBy(F.col("user_id").alias("__user")).agg(F.min(order).alias("__stop"))
    free = F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))
    return sums.join(stop, F.col("user_id").eqNullSafe(F.col("__user")), "left").where(free).select("user_id", order, "estimate", "quota", "used", "priority")
