"""Deduplication with a time to live, and alert digests: ordered state by key.

Streams keep the state of a key in Spark's state store. The batch twins find accepted rows and groups as greedy
chains (``operators.chains``), so that no key has to meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chains import taken
from ..operators.prefix import in_pieces, summed
from ..sources.stored import computed_once

TTL = 3_600_000_000
DEBOUNCE, RATE_LIMIT, MOST_HELD = 1_000_000, 7_200_000_000, 500


def accept(last: int | None, at: int, ttl: int) -> bool:
    """A repeat is let in once the accepted one is ``ttl`` old; a rejected one extends nothing."""
    return last is None or at - last >= ttl


#: Rows of a key that one task goes through in order; keys of more are worked on as chains.
HOT = 1 << 20


def dedup_with_ttl(rows: DataFrame, key: str = "email_id", ts: str = "ts", tie: str = "event_id", ttl: int = TTL, keep: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """Batch twin: key, ts, tie and ``keep`` of the accepted rows. Rows without a time are left out.

    The rows of a key pass through one task in order, a few columns wide. Keys of more than ``hot`` rows are
    told apart first and go by chains instead; the result is the same.
    """
    slim = rows.where(F.col(ts).isNotNull()).select(key, ts, tie, *keep, F.unix_micros(F.col(ts).cast("timestamp")).alias("__at"))
    schema = slim.drop("__at").schema
    many = computed_once(slim.groupBy(F.col(key).alias("__hot")).count().where(F.col("count") > hot).select("__hot"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = object(), None
        for batch in batches:
            accepted = []
            for k, at in zip(batch[key], batch["__at"], strict=True):
                if k != now:
                    now, last = k, None
                accepted.append(accept(last, at, ttl))
                last = at if accepted[-1] else last
            yield batch[accepted].drop(columns="__at")

    def streamed(some: DataFrame) -> DataFrame:
        return some.repartition(key).sortWithinPartitions(key, "__at", tie).mapInPandas(run, schema)

    if many.isEmpty():
        return streamed(slim)
    same = F.col(key).eqNullSafe(F.col("__hot"))
    chained = taken(slim.join(many, same, "left_semi"), [key], "__at", [tie], ttl).where("taken").select(*schema.names)
    return streamed(slim.join(many, same, "left_anti")).unionByName(chained)


def dedup_stream(stream: DataFrame, key: str = "email_id", ts: str = "ts", tie: str = "event_id", ttl: int = TTL, late: str = "10 minutes", keep: tuple[str, ...] = ()) -> DataFrame:
    """The same over a stream: the state of a key is the time of its last accepted row, and goes when
    the watermark passes that time by ``ttl``. ``stream``: key, ts (timestamp), tie and ``keep``."""
    slim = stream.select(key, ts, tie, *keep).withWatermark(ts, late)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([ts, tie])
        keep = []
        for at in rows[ts].astype("datetime64[us]").astype("int64"):
            keep.append(accept(last, at, ttl))
            last = at if keep[-1] else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last + ttl, state.getCurrentWatermarkMs() * 1000) // 1000 + 1)
        yield rows[keep]

    return slim.groupBy(key).applyInPandasWithState(run, slim.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def dedup_stream_cheap(stream: DataFrame, key: str = "email_id", ts: str = "ts", ttl: str = "1 hour") -> DataFrame:
    """Close to it with Spark's own operator: repeats within the watermark's delay are dropped."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def combine(messages: list[str]) -> str:
    """One message as it is; several as a numbered list under a heading."""
    if len(messages) == 1:
        return messages[0]
    return f"{len(messages)} critical errors:\n\n" + "".join(f"{k}. {m}\n" for k, m in enumerate(messages, 1))


class Digest:
    """The state of one channel: an open group, the last time that one was sent, and held alerts."""

    def __init__(self, opened: int | None = None, group: list[str] = (), sent: int | None = None, held: list[str] = ()):
        self.opened, self.group, self.sent, self.held = opened, list(group), sent, list(held)

    def close(self) -> tuple[int, str, int, str]:
        """(closing time, outcome, number of alerts, text): sent, or held if the last was sent lately."""
        at, group = self.opened + DEBOUNCE, self.group
        self.opened, self.group = None, []
        if self.sent is not None and at - self.sent < RATE_LIMIT:
            self.held = (self.held + group)[-MOST_HELD:]
            return at, "held", len(group), combine(group)
        self.sent = at
        return at, "sent", len(group), combine(group)

    def add(self, at: int, message: str) -> list[tuple[int, str, int, str]]:
        out = []
        if self.opened is not None and at > self.opened + DEBOUNCE:
            out.append(self.close())
        if self.opened is None:
            self.opened = at
        self.group.append(message)
        return out


DIGEST = "channel long, closed_at timestamp, outcome string, n int, text string"


def _frame(channel: int, groups: list[tuple[int, str, int, str]]) -> pd.DataFrame:
    return pd.DataFrame({"channel": [channel] * len(groups), "closed_at": pd.to_datetime([g[0] for g in groups], unit="us"), "outcome": [g[1] for g in groups], "n": [g[2] for g in groups], "text": [g[3] for g in groups]})


def combined(messages: Column) -> Column:
    """``combine`` as a column of an array of messages."""
    lines = F.transform(messages, lambda m, k: F.concat((k + 1).cast("string"), F.lit(". "), m, F.lit("\n")))
    many = F.concat(F.size(messages).cast("string"), F.lit(" critical errors:\n\n"), F.array_join(lines, ""))
    return F.when(F.size(messages) == 1, messages[0]).otherwise(many)


def alert_digest(alerts: DataFrame) -> DataFrame:
    """Batch twin over (channel, ts, message): every group with its outcome. A null message counts as empty.

    A group opens at the first alert later than a debounce after the one that opened the group before, and
    the groups that are sent close a rate limit or more after the one sent before: two greedy chains. Only
    a group's own messages meet in a task, for its text.
    """
    slim = alerts.select(F.col("channel").cast("long").alias("channel"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("message", F.lit("")).alias("message"))
    order = ["at", "message", "pos"]
    opening = computed_once(taken(slim, ["channel"], "at", ["message"], DEBOUNCE + 1))
    grouped = summed(in_pieces(opening, ["channel"], order), ["channel"], order, F.col("taken").cast("int"), "k")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "message"))), lambda m: m["message"])
    groups = grouped.groupBy("channel", "k").agg((F.min("at") + DEBOUNCE).alias("closed"), F.count(F.lit(1)).cast("int").alias("n"), combined(listed).alias("text"))
    done = taken(groups, ["channel"], "closed", ["k"], RATE_LIMIT)
    return done.select("channel", F.timestamp_micros("closed").alias("closed_at"), F.when(F.col("taken"), "sent").otherwise("held").alias("outcome"), "n", "text")


def alert_digest_stream(alerts: DataFrame, late: str = "10 seconds") -> DataFrame:
    """The same over a stream of (channel, ts, message); a group closes once the watermark passes it."""
    slim = alerts.select(F.col("channel").cast("long").alias("channel"), "ts", "message").withWatermark("ts", late)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        digest = Digest(*state.get) if state.exists else Digest()
        done = []
        if state.hasTimedOut:
            if digest.opened is not None:
                done.append(digest.close())
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "message"])
            for at, message in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["message"], strict=True):
                done += digest.add(int(at), message)
        state.update((digest.opened, digest.group, digest.sent, digest.held))
        if digest.opened is not None:
            state.setTimeoutTimestamp(max((digest.opened + DEBOUNCE) // 1000, state.getCurrentWatermarkMs()) + 1)
        if done:
            yield _frame(k[0], done)

    return slim.groupBy("channel").applyInPandasWithState(run, DIGEST, "opened long, messages array<string>, sent long, held array<string>", "append", GroupStateTimeout.EventTimeTimeout)
