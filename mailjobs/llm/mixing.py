"""Mixing sources to target weights with a time-varying curriculum.

Targets: sources share all tokens by weight; a target stops at ``max_epochs`` times its source's size
and the excess is shared again by weight among the others, in closed form (the cap of a source is
reached when cap / weight is below the common level).

Curriculum: each source's rate over training time t in [0, 1] is a piecewise linear schedule. Its
integral is the source's cumulative demand; a document that begins at token c of its source is placed
at the time at which the demand reaches c. Documents of a source follow each other in an order fixed
by a hash of doc_id and text, epoch after epoch. Range-sorting by position gives the training order.

Scale: cumulative sizes are a two-level prefix sum. A source's documents fall into about 2 * sqrt(n)
buckets by hash; a window runs over the buckets' totals and one inside each bucket, so no source, not
even one with a third of all rows, meets in one task.

Defined results: a null text has size 0; a document of size 0 takes nothing and is given no position;
a null source is a source of its own, last in order; null and repeated doc_ids are spread by their
texts, and rows that agree in both are interchangeable; an empty table gives no rows; other columns take
no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, count_words

#: Rate over time by a source's place in order, repeating: falling, level, rising.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (1.0, 1.5)),
)

#: Up to so many sources (a few MB) their targets are broadcast; beyond it Spark joins them by key.
BROADCAST_SOURCES = 50_000


def sized(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, source, size (words) and order (a hash of doc_id and text) of every row, and with ``keyed``
    key, a hash of all columns."""
    key = [F.xxhash64(*docs.columns).alias("key")] if keyed else []
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    return docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), order.alias("order"), *key)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3) -> DataFrame:
    """source, place (from 0), source_size, n_docs and target, from rows of source and size.

    The table has one row for each source; windows over it see sources, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ordered = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ordered = ordered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    # The level if all sources before this one (by cap / weight) are at their caps.
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero))
    ordered = ordered.withColumn("level", level).withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    # Of those not full the first has the common level; what follows it counts caps that aren't reached.
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * common)
    return ordered.select("source", "place", "source_size", "n_docs", target.alias("target"))


def demand_time(share: Column, place: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source's demand reaches ``share`` of its target: the inverse of the
    integral of its schedule, solved in the schedule's piece that holds it."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))
        found, done = F.lit(1.0), 0.0
        pieces = []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            here = (t1 - t0) * (w0 + w1) / 2 / area
            pieces.append((done, done + here, t0, t1 - t0, w0 / area, w1 / area))
            done += here
        for low, high, t0, width, w0, w1 in reversed(pieces):
            rest = F.greatest(share - F.lit(low), F.lit(0.0))
            slope = (w1 - w0) / width
            # w0 x + slope x^2 / 2 = rest, in the form that is stable for small slopes
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
            time = F.lit(t0) + F.when(F.lit(w0) + root > 0, 2 * rest / (F.lit(w0) + root)).otherwise(F.lit(0.0))
            found = F.when(share <= F.lit(high), F.least(time, F.lit(t0 + width))).otherwise(found)
        out = F.when(place % len(schedules) == k, found).otherwise(out)
    return out


def curriculum(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3, schedules=SCHEDULES, keyed: bool = False, cut: bool = True) -> DataFrame:
    """One row for each document: doc_id, key (a hash of the row, with ``keyed``), source, size,
    source_size, target, taken, and ``copies``, an array of (epoch, words, position) for each time that the
    mix reads it. The last copy of a source is cut where the target ends, so a source's taken words equal
    its target, rounded; without ``cut`` it is read whole if half of it or more lies before that end, else
    not at all, so they miss it by half a document at most."""
    rows = checkpointed(sized(docs, keyed))
    targets = checkpointed(source_targets(rows, weights, max_epochs))
    n_buckets = F.ceil(2 * F.sqrt("n_docs"))
    known = targets.withColumnRenamed("source", "of_source")
    if targets.count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    part = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") * n_buckets / F.lit(float(1 << 32))).cast("long")
    rows = rows.withColumn("bucket", part)
    key = ["key"] if keyed else []
    sums = rows.groupBy("place", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("place", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("place", "bucket").orderBy("order", F.col("doc_id").asc_nulls_last(), "size", *key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, ["place", "bucket"]).withColumn("begin", F.col("begin") + F.col("offset"))
    whole = F.round("target").cast("long")

    def copy(epoch: Column) -> Column:
        start = F.col("begin") + epoch * F.col("source_size")
        words = F.greatest(F.least(F.col("size"), whole - start), F.lit(0))
        if not cut:
            words = F.when((words > 0) & (2 * words >= F.col("size")), F.col("size")).otherwise(F.lit(0).cast("long"))
        return F.struct(epoch.cast("int").alias("epoch"), words.alias("words"), demand_time(F.try_divide(start, F.col("target")), F.col("place"), schedules).alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), copy), lambda c: c["words"] > 0)
    rows = rows.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    return rows.select("doc_id", *key, "source", "size", "source_size", "target", taken.alias("taken"), "copies")


def by_position(mixed: DataFrame) -> DataFrame:
    """The documents range-sorted by the position of their first copy, those that are never read last."""
    return mixed.orderBy(F.get("copies", F.lit(0))["position"].asc_nulls_last(), F.col("source").asc_nulls_last(), "doc_id")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each copy, range-sorted by position (ties by source and doc_id)."""
    each = mixed.select("doc_id", "source", F.explode("copies").alias("c")).select("doc_id", "source", "c.epoch", "c.words", "c.position")
    return each.orderBy("position", F.col("source").asc_nulls_last(), "doc_id", "epoch")


def materialise(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3, schedules=SCHEDULES, cut: bool = True) -> DataFrame:
    """The mix itself: the columns of ``docs`` with one row for each copy, range-sorted by position.

    A copy that is read in part carries its text up to the last word read, and n_chars, if there is
    such a column, follows; without ``cut`` (as in ``curriculum``) every copy is a whole text. Rows that agree in all columns are one row to the join and have the copies
    of all of them.
    """
    names = ["__doc_id", "__key"]
    plan = curriculum(docs, weights, max_epochs, schedules, keyed=True, cut=cut)
    plan = plan.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__doc_id"), F.col("key").alias("__key"), F.explode("copies").alias("__c"))
    rows = docs.withColumns({"__key": F.xxhash64(*docs.columns), "__doc_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))})
    rows = rows.dropDuplicates(names).join(plan, names)
    if not cut:
        return rows.orderBy("__c.position", "doc_id", "__c.epoch").select(*docs.columns)
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("__c.words").cast("int")), "")
    text = F.when(F.col("__c.words") < count_words(F.col("text")), part).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.orderBy("__c.position", "doc_id", "__c.epoch").select(*docs.columns)
