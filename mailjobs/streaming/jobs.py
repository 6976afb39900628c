"""Streams of the pipeline: windows, and micro-batch jobs that reuse the batch operators.

The micro-batch functions are given to ``foreachBatch``. Each writes into a folder named by the batch
id and overwrites it, so a replayed batch leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.emails import lookback_filter, unprocessed_ids
from ..operators.rules import route_after_first
from ..operators.usage import tokens_by_user
from ..sources.tables import insert_ignore
from .ttl import TTL, dedup_stream, dedup_with_ttl


def rolling_counts(rows: DataFrame, length: str = "24 hours", slide: str = "1 hour", late: str | None = None) -> DataFrame:
    """user_id, window_start, n over sliding windows; a stream needs ``late``, a batch takes none.

    Rows are counted once in panes as long as the slide, and panes are added up, so that no row is copied
    into all its windows. ``length`` is a multiple of ``slide``.
    """
    rows = rows.withWatermark("ts", late) if late else rows
    panes = rows.groupBy("user_id", F.window("ts", slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.window_time("w").alias("ts"), "n")
    return panes.groupBy("user_id", F.window("ts", length, slide).alias("w")).agg(F.sum("n").alias("n")).select("user_id", F.col("w.start").alias("window_start"), "n")


def throughput(rows: DataFrame, length: str = "10 seconds", late: str | None = None) -> DataFrame:
    """window_start, n, per_second over tumbling windows."""
    seconds = {"second": 1, "minute": 60, "hour": 3600}[length.split()[1].rstrip("s")] * int(length.split()[0])
    rows = rows.withWatermark("ts", late) if late else rows
    return rows.groupBy(F.window("ts", length).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "n", (F.col("n") / F.lit(float(seconds))).alias("per_second"))


def new_ids(ids: DataFrame, processed: DataFrame, now_ms: Column, days: int, ttl: int = TTL) -> DataFrame:
    """user_id, id, ts, arrival of the ids to take in, of a batch: in the lookback, not stored for their user,
    and not let in less than ``ttl`` ago for any user. ``ids``: user_id, id, internal_date, ts (when it was
    seen), arrival."""
    fresh = unprocessed_ids(lookback_filter(ids, now_ms, days), processed)
    return dedup_with_ttl(fresh, "id", tie="arrival", ttl=ttl, keep=("user_id",))


def new_ids_stream(ids: DataFrame, processed: DataFrame, now_ms: Column, days: int, ttl: int = TTL, late: str = "10 minutes") -> DataFrame:
    """The same over a stream: the times of acceptance are kept by id across micro-batches, and go when the
    watermark passes them by ``ttl``. ``processed`` is joined as it stands when the stream starts, or anew
    for each micro-batch if its source is read so (a table of a database, say)."""
    fresh = unprocessed_ids(lookback_filter(ids, now_ms, days), processed)
    return dedup_stream(fresh, "id", tie="arrival", ttl=ttl, late=late, keep=("user_id",))


def ingest_new_ids(processed: Callable[[], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch of ``new_ids_stream``: what is still not stored, written. ``processed`` is read anew for
    each batch, for ids that were stored since the stream started."""

    def run(batch: DataFrame, batch_id: int) -> None:
        unprocessed_ids(batch, processed()).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return run


def route_items(out: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch: items after the first pass, written by their next stage."""

    def run(batch: DataFrame, batch_id: int) -> None:
        route_after_first(batch).write.mode("overwrite").partitionBy("stage").parquet(f"{out}/batch={batch_id}")

    return run


def usage_stream(emails: Callable[[], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch of finished items: token totals by user, and the emails to append. Totals of all
    batches add up to the usage; a replayed batch replaces its own."""

    def run(batch: DataFrame, batch_id: int) -> None:
        tokens_by_user(batch).write.mode("overwrite").parquet(f"{out}/usage/batch={batch_id}")
        insert_ignore(batch, emails(), "id", "user_id").write.mode("overwrite").parquet(f"{out}/emails/batch={batch_id}")

    return run


def retry_failed(failed: DataFrame, max_retries: int = 3) -> DataFrame:
    """id, stage, attempts, outcome of failures (one row each): back to its stage, or dropped once the
    attempts pass the limit."""
    n = failed.groupBy("id", "stage").agg(F.count(F.lit(1)).alias("attempts"))
    return n.withColumn("outcome", F.when(F.col("attempts") > max_retries, "dropped").otherwise("requeued"))
