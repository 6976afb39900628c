"""Rows of one table met by rows of another in blocks, without pairs of rows in a shuffle.

Rows of the first table are dealt to blocks of bounded size by hash and kept in a task while rows of the
second, which go to every block of their key, are streamed past them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stored import computed_once

#: Vector components that a block holds, about.
CELLS = 1 << 22
#: Rows that are worth a block of their own.
LEAST_ROWS = 64
#: Keys whose numbers of blocks may be broadcast.
FEW_KEYS = 100_000


def matrix(column: pa.Array) -> np.ndarray:
    """Equal-length vectors as rows of doubles; null components are not numbers."""
    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def streamed_past(kept: DataFrame, passing: DataFrame, keys: list[str], spread: list[str], rows: int, block: Callable[[pa.RecordBatch], object], schema: T.StructType | str) -> DataFrame:
    """What ``block`` objects yield: one is made of all ``kept`` rows of a block, its ``meet`` gets the
    ``passing`` rows of the block's key batch by batch, and ``end`` is called when they are through. Both
    methods yield record batches. Blocks hold about ``rows`` rows at most, dealt by the hash of the columns ``spread``,
    which should tell a key's rows apart: rows equal in them share a block.
    """
    names = [f"k{k}" for k in range(len(keys))]
    keyed = lambda d: d.select(F.struct(*d.columns).alias("row"), *(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)))
    left, right = keyed(kept), keyed(passing)
    counts = computed_once(left.groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    n_keys, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    slots = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = min(rows, max(LEAST_ROWS, -(-(total or 0) // slots)))  # smaller blocks where slots would have none
    sizes = counts.select(*names, F.ceil(F.col("n") / rows).cast("int").alias("parts"))
    sizes = F.broadcast(sizes) if n_keys <= FEW_KEYS else sizes
    side = [*names, "part", "kind", "kept", "passing"]
    own = F.pmod(F.xxhash64(*(f"row.{c}" for c in spread)), F.col("parts")).cast("int")
    nothing = lambda d: F.lit(None).cast(T.StructType(d.schema.fields))
    a = left.join(sizes, names).select(*names, own.alias("part"), F.lit(0).alias("kind"), F.col("row").alias("kept"), nothing(passing).alias("passing"))
    b = right.join(sizes, names).select(*names, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), nothing(kept).alias("kept"), F.col("row").alias("passing"))
    width = len(names) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, open_ = None, [], None

        def ended() -> Iterator[pa.RecordBatch]:
            if open_ is not None or waiting:
                yield from (open_ or block(_joined(waiting))).end()

        for batch in batches:
            for begin, end in _stretches([batch.column(c) for c in range(width + 1)]):
                part = batch.slice(begin, end - begin)
                key = [part.column(c)[0].as_py() for c in range(width)]
                if key != now:
                    yield from ended()
                    now, waiting, open_ = key, [], None
                if part.column(width)[0].as_py() == 0:
                    waiting.append(_fields(part.column(width + 1)))
                elif waiting or open_ is not None:
                    if open_ is None:
                        open_, waiting = block(_joined(waiting)), []
                    yield from open_.meet(_fields(part.column(width + 2)))
        yield from ended()

    together = a.unionByName(b).select(*side).repartition(*names, "part").sortWithinPartitions(*names, "part", "kind")
    return together.mapInArrow(run, schema)


def _fields(column: pa.StructArray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(column.flatten(), names=[f.name for f in column.type])


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _stretches(columns: list[pa.Array]) -> list[tuple[int, int]]:
    """Where rows of equal columns begin and end; equal rows stand together."""
    n = len(columns[0])
    if not n:
        return []
    codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in columns]
    change = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in codes], axis=0)))
    return list(zip(change.tolist(), np.append(change[1:], n).tolist(), strict=True))
