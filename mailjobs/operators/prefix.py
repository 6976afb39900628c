"""Running sums and sliding frames inside a key that may hold a large part of all rows.

Plain windows put a key into one task. Here a key is cut along its order: sums inside each piece, and
offsets from the pieces' totals, which are few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import computed_once

#: Rows of a piece, about.
ROWS = 1 << 18


def in_pieces(df: DataFrame, keys: list[str], order: list[str], pieces: int | None = None, rows: int = ROWS) -> DataFrame:
    """Adds ``__piece``: ranges of rows by keys and order, of nearly equal size wherever a key's rows lie.

    The input is computed once. Their number follows the number of rows; Spark samples the bounds. Rows
    equal in keys and order share a piece, so the order should tell a key's rows apart.
    """
    once = computed_once(df)
    if pieces is None:
        slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pieces = max(slots, -(-once.count() // rows))
    return computed_once(once.repartitionByRange(pieces, *keys, *order).withColumn("__piece", F.spark_partition_id()))


def summed(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Adds to rows in pieces the sum of ``value`` over a key's rows up to each row, with it or without.
    ``rows`` should be computed already: they are read for the sums and for the totals."""
    rows = rows.withColumn("__value", value.cast("long"))
    inside = Window.partitionBy(*keys, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, "__piece").agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__piece").alias("__of"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    same = F.col("__piece") == F.col("__of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    own = F.lit(0) if inclusive else F.coalesce(F.col("__value"), F.lit(0))
    sums = rows.withColumn(name, F.coalesce(F.sum("__value").over(inside), F.lit(0)) - own)
    return sums.join(offsets, same).select(*(c for c in rows.columns if c not in (name, "__value")), (F.col(name) + F.col("__offset")).alias(name))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, pieces: int | None = None, inclusive: bool = True) -> DataFrame:
    """Adds the sum of ``value`` over a key's rows up to each row in ``order``, with it or without."""
    return summed(in_pieces(df, keys, order, pieces), keys, order, value, name, inclusive).select(*df.columns, name)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, pieces: int | None = None) -> DataFrame:
    """Adds each row's position in its key, from 1."""
    return running_sum(df, keys, order, F.lit(1), name, pieces)


def added(x: Column, y: Column) -> Column:
    """The sum of both, or the one that isn't null."""
    return F.coalesce(x + y, x, y)


def over_sliding_range(df: DataFrame, key: str, at: Column, micros: int, values: dict[str, Column], merged: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Adds aggregates over a key's rows from ``micros`` before each row up to it, both included.

    Time is cut into slices as long as the frame, so a frame is the end of one slice and the beginning of
    the next, and a busy key is spread over its slices. Both parts are running aggregates, one in the order of time and
    one against it, and so take time in proportion to the rows however many a frame holds; a frame that slides
    would go through its rows again for each row. ``merged`` says how an aggregate of both parts is made from
    those of each, where it isn't their sum.

    Aggregates may use ``__at`` (the time) and ``__one`` (1), and should ignore rows of nulls only: each row
    stands as such among those of the slice before, where its frame begins.
    """
    rows = df.withColumn("__at", at).withColumn("__one", F.lit(1)).withColumn("__own", F.floor(F.col("__at") / micros))
    from_start = Window.partitionBy(key, "__own").orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    ended = rows.select("*", *(v.over(from_start).alias(f"__last_{name}") for name, v in values.items()))
    kept = [*df.columns, *(f"__last_{name}" for name in values)]
    seen = [c for c in (*df.columns, "__at", "__one") if c != key]
    # Two rows of each: what counts in the slice after its own, and the beginning of its frame in its own.
    context = F.struct(F.lit(True).alias("counts"), (F.col("__own") + 1).alias("slice"), F.col("__at").alias("place"))
    begin = F.struct(F.lit(False).alias("counts"), F.col("__own").alias("slice"), (F.col("__at") - micros).alias("place"))
    both = ended.withColumn("__row", F.struct(*kept)).withColumn("__as", F.explode(F.when(F.col("__own").isNull(), F.array(begin)).otherwise(F.array(context, begin))))
    counts = F.col("__as.counts")
    both = both.select(key, *(F.when(counts, F.col(c)).alias(c) for c in seen), F.when(~counts, F.col("__row")).alias("__row"), F.col("__as.slice").alias("__slice"), F.col("__as.place").alias("__place"))
    to_end = Window.partitionBy(key, "__slice").orderBy(F.desc("__place")).rangeBetween(Window.unboundedPreceding, 0)
    begun = both.select("*", *(v.over(to_end).alias(f"__first_{name}") for name, v in values.items())).where("__row is not null")
    join = {name: (merged or {}).get(name, added) for name in values}
    return begun.select(*(F.col(f"__row.{c}").alias(c) for c in df.columns), *(join[name](F.col(f"__first_{name}"), F.col(f"__row.__last_{name}")).alias(name) for name in values))
