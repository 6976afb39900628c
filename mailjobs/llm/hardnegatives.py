"""Hard negatives by coordinate pruning of inner-product search, after LEMP.

An anchor's positives are its nearest rows of the same label; its hard negatives are the nearest rows of
other labels whose score lies in a window below a positive's score. Scores are inner products of vectors
rounded down to integers, so they are exact.

Rows are dealt to units of bounded size by hash. A unit's vectors are put into buckets of like length,
longest first. Each coordinate of a bucket has a list of its values over the bucket's unit vectors, sorted
when it is first asked for. For a score of at least ``low``, an anchor's ``FOCUS`` strongest coordinates each
admit a range of values: with the cosines x of the coordinate and t of the score over the longest length,
x t -+ sqrt((1 - x^2) (1 - t^2)). The rows that are in the range of every such list are scored exactly. The
bound rises with the best scores found, and the first bucket too short for it ends the search. Without a
positive bound every score is feasible.

Scale: a unit's entries are shuffled once; anchors (one in ``every``) go to each unit of theirs and are
streamed past its entries, so a task holds one unit and one batch of anchors whatever the number of either.
Positives are searched in units of the anchor's label only. Equal vectors of a label are one entry with the
smallest ids that a result can need, and equal anchors are searched once. A unit returns for each anchor
no more than the rows that its result can hold.

Defined results: rows with a null vec_id, label or vector, or with null or non-finite components take no
part; vectors of different lengths have no score with each other; rows that repeat vec_id, label and
vector count once, and no row is a positive of an anchor of its vec_id; ties go to the smaller vec_id; an
anchor without positives or without rows in a window has no rows for it; an empty table gives no rows; other
columns take no part. Scores beyond a long are held at its ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, stored
from .neighbours import smallest_ids

#: Components of a unit's vectors at most, and the rows that are worth a unit of their own.
CELLS, LEAST_ROWS = 1 << 22, 1024
#: Groups whose numbers of units may be broadcast.
FEW_GROUPS = 100_000
#: A bucket ends where vectors are shorter than this share of its longest.
RATIO = 0.9
#: Coordinates whose ranges are intersected.
FOCUS = 5
#: Against rounding in the ranges, which are taken from square roots near zero.
SLACK = 1e-7
LONG = (1 << 63) - 1
KEYS = ["h1", "h2"]


class Bucket:
    """Vectors of like length: ``at`` their rows in the unit."""

    def __init__(self, vectors: np.ndarray, length: np.ndarray, at: np.ndarray):
        self.vectors, self.at, self.longest = vectors, at, float(length.max())
        self.unit = vectors / np.maximum(length, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def values(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows by their value of the coordinate, and the values."""
        if coordinate not in self.lists:
            column = self.unit[:, coordinate]
            order = np.argsort(column, kind="stable").astype(np.int32)
            self.lists[coordinate] = order, column[order]
        return self.lists[coordinate]

    def feasible(self, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray:
        """The rows in all focus coordinates' ranges for a cosine of at least ``cosine``."""
        rest = math.sqrt(max(0.0, 1 - cosine * cosine))
        ranges = []
        for f in focus:
            x = float(unit[f])
            width = math.sqrt(max(0.0, 1 - x * x)) * rest
            low = -1.0 if x <= -cosine else x * cosine - width
            high = 1.0 if x >= cosine else x * cosine + width
            order, values = self.values(int(f))
            a, b = np.searchsorted(values, (low - SLACK, high + SLACK))
            ranges.append((int(b - a), int(a), int(f), low, high, order))
        ranges.sort(key=lambda r: r[:3])
        n, a, _, _, _, order = ranges[0]
        found = order[a : a + n]
        for n, _, f, low, high, _ in ranges[1:]:
            if n < len(self.at):  # else the range holds every row
                value = self.unit[found, f]
                found = found[(value >= low - SLACK) & (value <= high + SLACK)]
        return found


class Unit:
    """The entries of one unit: integer vectors, smallest ids and labels."""

    def __init__(self, vectors: np.ndarray, first: np.ndarray, label: np.ndarray):
        self.vectors, self.first, self.label = vectors, first, label
        # Magnitudes as floats: the least long has no absolute value.
        self.most = float(np.abs(vectors.astype(np.float64)).max(initial=0))
        floats = vectors.astype(np.float64)
        length = np.sqrt((floats**2).sum(axis=1))
        order = np.lexsort((first, -length))
        self.buckets: list[Bucket] = []
        begin = 0
        while begin < len(order):
            end = begin + int(np.searchsorted(-length[order[begin:]], -RATIO * length[order[begin]], side="right"))
            at = order[begin:end]
            self.buckets.append(Bucket(floats[at], length[at], at))
            begin = end

    def scores(self, bucket: Bucket, rows: np.ndarray | None, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products, as longs: in floats while all sums are whole numbers below 2^53."""
        if self.most * float(np.abs(anchor.astype(np.float64)).max(initial=0)) * len(anchor) < 2**53:
            if rows is None or 2 * len(rows) > len(bucket.at):  # one product over all is faster than picking most
                found = bucket.vectors @ anchor.astype(np.float64)
                return (found if rows is None else found[rows]).astype(np.int64)
            return (bucket.vectors[rows] @ anchor.astype(np.float64)).astype(np.int64)
        at = bucket.at if rows is None else bucket.at[rows]
        wide = [sum(int(x) * int(y) for x, y in zip(v, anchor, strict=True)) for v in self.vectors[at]]
        return np.array([max(-LONG - 1, min(LONG, x)) for x in wide], dtype=np.int64)

    def search(self, anchor: np.ndarray, windows: list[tuple[int, int]], k: int, apart: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores its best k (scores, entries), by score, then smallest id; entries of the
        label ``apart`` are left out."""
        floats = anchor.astype(np.float64)
        length = math.sqrt(float((floats**2).sum()))
        unit = floats / max(length, 1e-300)
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
        low = [a for a, _ in windows]

        def offer(scores: np.ndarray, at: np.ndarray) -> None:
            if apart is not None:
                other = self.label[at] != apart
                scores, at = scores[other], at[other]
            for w, (_, high) in enumerate(windows):
                good = (scores >= low[w]) & (scores <= high)
                if not good.any():
                    continue
                s, e = np.append(best[w][0], scores[good]), np.append(best[w][1], at[good])
                _, one = np.unique(e, return_index=True)
                s, e = s[one], e[one]
                top = np.lexsort((self.first[e], -s))[:k]
                best[w] = s[top], e[top]
                if len(top) == k:
                    low[w] = max(low[w], int(s[top[-1]]))

        for bucket in self.buckets:
            bound = min(low, default=LONG)
            if bound > 0 and length * bucket.longest * (1 + 1e-12) < bound:
                break
            if bound < 0 and len(focus) and len(bucket.at) > 8 * k:
                # Nothing known yet: the rows that are furthest in the strongest coordinate give a bound.
                order, _ = bucket.values(int(focus[0]))
                some = order[-4 * k :] if unit[focus[0]] >= 0 else order[: 4 * k]
                offer(self.scores(bucket, some, anchor), bucket.at[some])
                bound = min(low, default=LONG)
            rows = None
            if bound > 0 and len(focus) and length * bucket.longest > 0:
                rows = bucket.feasible(unit, focus, min(1.0, bound / (length * bucket.longest)))
            offer(self.scores(bucket, rows, anchor), bucket.at if rows is None else bucket.at[rows])
        return best


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v (the components times ``scale``, rounded down) of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).where(good)
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def units(entries: DataFrame, group: list[str]) -> DataFrame:
    """The values of ``group`` with the number of units that their entries are dealt to: units are as large as
    ``CELLS`` allows, or smaller where that would leave slots without one."""
    counts = checkpointed(entries.groupBy(*group).agg(F.count(F.lit(1)).alias("n")))
    groups, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    slots = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = F.least(F.floor(F.lit(CELLS) / F.greatest("dim", F.lit(1))), F.lit(max(LEAST_ROWS, -(-(total or 0) // slots))))
    found = counts.select(*group, F.ceil(F.col("n") / F.greatest(rows, F.lit(1))).cast("int").alias("parts"))
    return F.broadcast(found) if groups <= FEW_GROUPS else found


FOUND = "h1 long, h2 long, wanted long, score long, ids array<long>"


def searched(entries: DataFrame, anchors: DataFrame, k: int, apart: bool, window: tuple[int, int]) -> DataFrame:
    """FOUND: for each anchor, and each score ``wanted`` of its ``scores``, the best k entries of every unit:
    entries of other labels within a window of percents of the score, or, without ``apart``, all entries
    of its own label, with ``wanted`` 0."""
    group = ["g", "dim"]
    entries, anchors = (d.withColumn("g", F.lit(0).cast("long") if apart else F.col("label")) for d in (entries, anchors))
    parts = units(entries, group)
    names = [*group, "part", "kind", *KEYS, "label", "v", "ids", "scores"]
    hashed = F.pmod(F.xxhash64(*KEYS, F.lit(3)), F.col("parts")).cast("int")
    dealt = entries.join(parts, group).select("*", hashed.alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("array<long>").alias("scores")).select(*names)
    asked = anchors.join(parts, group).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"))
    asked = asked.withColumn("ids", F.lit(None).cast("array<long>")).select(*names)
    def windows(scores: list[int]) -> list[tuple[int, int]]:
        return [(-((-window[0] * s) // 100), window[1] * s // 100) for s in scores]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, unit, ids = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)])
            starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                key, rows = tuple(keys[:-1, a].tolist()), batch.slice(a, b - a)
                if key != now:
                    now, waiting, unit, ids = key, [], None, None
                h1, h2, label, v, first, scores = (rows.column(4 + c) for c in range(6))
                matrix = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), -1) if len(v.flatten()) else np.zeros((len(v), 0), np.int64)
                if keys[-1, a] == 0:
                    waiting.append((matrix, label.to_numpy(), first))
                    continue
                if unit is None:
                    if not waiting:
                        continue
                    ids = pa.concat_arrays([x[2] for x in waiting])
                    smallest = ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]
                    unit, waiting = Unit(np.concatenate([x[0] for x in waiting]), smallest, np.concatenate([x[1] for x in waiting])), []
                out: list[list[np.ndarray]] = []
                for r in range(len(rows)):
                    wanted = scores[r].as_py() if apart else [None]
                    asks = windows(wanted) if apart else [(-LONG - 1, LONG)]
                    for want, (score, at) in zip(wanted, unit.search(matrix[r], asks, k, label[r].as_py() if apart else None), strict=True):
                        if len(at):
                            same = lambda x, n=len(at): np.full(n, x, dtype=np.int64)
                            out.append([same(h1[r].as_py()), same(h2[r].as_py()), same(want or 0), score, at])
                if out:
                    cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols[:4]), ids.take(pa.array(cols[4]))], names=["h1", "h2", "wanted", "score", "ids"])

    order = [*group, "part", "kind"]
    return dealt.unionByName(asked).repartition(*order[:-1]).sortWithinPartitions(*order).mapInArrow(run, FOUND)


def best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, and ``rows``: its k best (rank, score, vec_id)."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    ranked = found.select(*by, "score", F.explode("ids").alias("vec_id")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("rows"))


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each vec_id divisible by
    ``every`` and each of its nearest rows of the same label, the nearest rows of other labels whose score is
    from the first to the second percent of the positive's."""
    rows = usable(vectors, scale)
    hashed = rows.select("vec_id", "label", "v", F.xxhash64("label", "v").alias("h1"), F.xxhash64("v", "label", F.lit(1)).alias("h2"))
    marked, _ = stored(hashed)
    k = max(positives + 1, negatives)
    ids = smallest_ids(marked.select(*KEYS, "vec_id"), KEYS, k).groupBy(*KEYS).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    whole = marked.groupBy(*KEYS).agg(F.first("label").alias("label"), F.first("v").alias("v"))
    entries, _ = stored(whole.join(ids, KEYS).withColumn("dim", F.size("v")))
    asking = marked.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), *KEYS).distinct()
    anchors = entries.drop("ids").join(asking.select(*KEYS).distinct(), KEYS, "left_semi").withColumn("scores", F.lit(None).cast("array<long>"))
    near, _ = stored(best(searched(entries, anchors, positives + 1, False, window), KEYS, positives + 1))
    scores = near.select(*KEYS, F.array_distinct(F.col("rows.score")).alias("scores"))
    below = best(searched(entries, anchors.drop("scores").join(scores, KEYS), negatives, True, window), [*KEYS, "wanted"], negatives)
    return pairs(asking, near, below, positives)


def pairs(asking: DataFrame, near: DataFrame, below: DataFrame, positives: int) -> DataFrame:
    """The rows of all anchors: equal anchors have the same search results, but for themselves. Many equal
    anchors are a skewed side of plain joins, which Spark splits at run time."""
    by_score = below.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("wanted", "rows"))).alias("below"))
    results = near.join(by_score, KEYS)
    other = lambda c: F.slice(F.filter(c, lambda p: p["vec_id"] != F.col("anchor_id")), 1, positives)
    own = asking.join(results, KEYS).select("anchor_id", "below", F.explode(other(F.col("rows"))).alias("p"))
    out = own.select("anchor_id", "p", F.explode(F.col("below")[F.col("p.score")]).alias("n"))
    return out.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("n.rank").cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))
