"""Greedy chains: of a key's rows in order of time, the first is taken, then the first at least ``gap`` after
the one taken last, and so on. Each choice depends on the one before, yet no key has to meet in one task.

Every row points to the row that would follow it. Positions and pointers are prefix sums. Rows are cut into
blocks of a key's positions; in a block, each row's path is followed to its exit, the first row beyond it.
Only rows that are exits of some block can be entered, and pointer doubling over these finds the ones that the
chain enters: after r rounds all within 2^r blocks. A last pass over the blocks follows the chain from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stored import computed_once
from .prefix import in_pieces, summed

#: Positions of a key that are worked on together.
BLOCK = 1 << 14


def followers(rows: DataFrame, gap: int) -> DataFrame:
    """key, pos, next from key, at, pos: each row looks for the first position at ``at + gap`` or later, which
    is one more than the number of rows before that time, and not itself. May lie beyond the last."""
    there = rows.select("key", F.col("at").alias("t"), F.lit(1).alias("kind"), "pos")
    asking = rows.select("key", (F.col("at") + gap).alias("t"), F.lit(0).alias("kind"), "pos")
    order = ["t", "kind", "pos"]
    counted = summed(in_pieces(there.unionByName(asking), ["key"], order), ["key"], order, F.col("kind"), "before")
    return counted.where("kind = 0").select("key", "pos", (F.greatest("before", "pos") + 1).alias("next"))


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by key and block, regrouped so that none ends inside a block."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        table = pa.Table.from_batches(waiting)
        last = np.flatnonzero(_changes([table.column(c).to_numpy() for c in range(2)]))[-1]
        if last:
            yield table.slice(0, last)
            waiting = table.slice(last).to_batches()
    if waiting:
        yield pa.Table.from_batches(waiting)


def _changes(keys: list[np.ndarray]) -> np.ndarray:
    return np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))


def inside(pos: np.ndarray, following: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The row that each row's pointer leads to inside its block, -1 where it leads beyond. ``start`` names
    the first row of each row's block."""
    sizes = np.bincount(start, minlength=len(start))[start]
    there = np.arange(len(pos)) + (following - pos)
    return np.where(there < start + sizes, there, -1)


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    """For each row the first row of its block."""
    change = _changes(keys)
    at = np.flatnonzero(change)
    return np.repeat(at, np.diff(np.append(at, len(change))))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_blocks(batches):
        key, block, pos, out = (table.column(c).to_numpy().copy() for c in range(4))
        to = inside(pos, out, _starts([key, block]))
        while (to >= 0).any():
            on = to >= 0
            out, to = np.where(on, out[to], out), np.where(on, to[to], -1)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(pos), pa.array(out)], names=["key", "pos", "to"])


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_blocks(batches):
        key, block, pos, following = (table.column(c).to_numpy() for c in range(4))
        taken = table.column(4).to_numpy(zero_copy_only=False).copy()
        to, front = inside(pos, following, _starts([key, block])), np.flatnonzero(taken)
        while len(front):
            front = to[front]
            front = front[front >= 0]
            taken[front] = True
        yield pa.RecordBatch.from_arrays([pa.array(key[taken]), pa.array(pos[taken])], names=["key", "pos"])


def entered(hops: DataFrame) -> DataFrame:
    """key, pos of all rows on the paths from position 1 over ``hops`` (key, pos, to), by pointer doubling."""
    found = computed_once(hops.where("pos = 1").select("key", "pos"))
    jumps = hops
    while True:
        new = computed_once(found.join(jumps, ["key", "pos"]).select("key", F.col("to").alias("pos")).join(hops, ["key", "pos"], "left_semi"))
        if new.isEmpty():
            return found
        found = computed_once(found.unionByName(new).distinct())
        ahead = jumps.select("key", F.col("pos").alias("to"), F.col("to").alias("further"))
        jumps = computed_once(jumps.join(ahead, ["key", "to"]).select("key", "pos", F.col("further").alias("to")))


def taken(rows: DataFrame, keys: list[str], at: str, order: list[str], gap: int) -> DataFrame:
    """``rows`` with ``pos``, the position in its key from 1, and ``taken``: whether the row is in its key's
    chain. ``at``: a long; rows without it are left out; ties go by ``order``."""
    named = rows.where(F.col(at).isNotNull()).withColumn("__key", F.xxhash64(*keys))
    ordered = [at, *order]
    numbers = computed_once(summed(in_pieces(named, ["__key", *keys], ordered), ["__key", *keys], ordered, F.lit(1), "pos").drop("__piece"))
    # Keys are named by their hash and told apart by their first row, so that equal hashes don't mix.
    marks = numbers.select(F.struct("__key", *keys).alias("s"), F.col(at).alias("at"), "pos")
    ids = marks.where("pos = 1").select("s", F.monotonically_increasing_id().alias("key"))
    ids = computed_once(ids)
    narrow = computed_once(marks.join(ids, "s").select("key", "at", "pos"))
    pointers = computed_once(followers(narrow, gap).withColumn("block", F.floor((F.col("pos") - 1) / BLOCK)).select("key", "block", "pos", "next"))
    dealt = lambda d: d.repartition("key", "block").sortWithinPartitions("key", "block", "pos")
    exits = computed_once(dealt(pointers).mapInArrow(_exits, "key long, pos long, to long"))
    ports = exits.select("key", F.col("to").alias("pos")).unionByName(ids.select("key", F.lit(1).cast("long").alias("pos"))).distinct()
    doors = entered(computed_once(exits.join(ports, ["key", "pos"])))
    marked = pointers.join(doors.withColumn("door", F.lit(True)), ["key", "pos"], "left").select("key", "block", "pos", "next", F.coalesce("door", F.lit(False)).alias("door"))
    chain = dealt(marked).mapInArrow(_followed, T.StructType([T.StructField("key", T.LongType()), T.StructField("pos", T.LongType())]))
    own = chain.join(ids, "key").select("s", "pos", F.lit(True).alias("taken"))
    full = numbers.withColumn("s", F.struct("__key", *keys)).join(own, ["s", "pos"], "left")
    return full.select(*rows.columns, "pos", F.coalesce("taken", F.lit(False)).alias("taken"))
