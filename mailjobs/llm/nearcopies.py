"""Near copies: SimHash comparison, then the exact Jaccard similarity of word shingles.

A text is the set of its shingles' hashes, and its fingerprint the SimHash of that set. At a similarity of
0.8 fingerprints lie about 10 bits apart and up to 20, too far for blocks of equal bits, so buckets are
formed by shingles instead. All sets share one order of shingles, frequent ones last. Two sets of similarity
t or more must have a shingle in common among the first n - ceil(t n) + 1 of both (prefix filter). Inside a
bucket fingerprints are compared bit by bit as in ``simhash`` (planes, carry-save counters, blocks abandoned
beyond the radius); sizes and places in the prefix rule out more, sketches of the sets most of the rest, and
what is left is verified by the exact similarity of the whole sets.

Every step but the fingerprints' radius is exact. Of sets of ``SHORT`` shingles or more at similarity 0.8 a
bit differs with a probability of 0.154 at most, more than ``RADIUS`` of 64 bits with one of about 1e-8, less
for nearer ones; shorter sets are compared without fingerprints.

Scale: equal sets are one entry; which shingles are frequent is estimated on a sample, which decides how
many candidates there are but never which pairs are linked; buckets of more than ``split`` rows are dealt
out as pairs of parts. Pairs are listed in two passes. The first lists for each row of a bucket the one or two
rows before it by size, so no more than two pairs a row; these are verified and their components formed. The
second compares all sets of a bucket that lie in different components by then, where they meet, and lists no
pair but links: first the rows are picked that have another one within the fingerprints' radius, of these the
ones whose sketches leave a link open, and these come with their whole sets. A bucket then gives a forest of its
links, less than one a row. So what is written and shuffled is in proportion to rows, also where a group's
texts come close to each other without being linked; only comparisons inside a task grow with pairs.

Defined results: texts without a word are equal to each other and to nothing else; texts of fewer words
than a shingle have one; repeated rows, null doc_ids and other columns as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, remove, short, stored
from .simhash import _lower, _words, connected_components, kept_rows, linked, over_half

#: Against rounding in products of the similarity with sizes; errs on the side of more candidates.
SLACK = 1e-9
#: Bits that fingerprints of near copies may differ in (64: all, the exact way), and the size of sets from
#: which they are used.
RADIUS, SHORT = 28, 64


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The ascending distinct XXH64 of all word shingles, A-Z lower-cased."""
    from xxhash import xxh64_digest

    words = _words((text or "").encode("utf-8", "replace").translate(_lower))
    if not words:
        return np.empty(0, dtype=np.int64)
    found = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.unique(np.frombuffer(b"".join(map(xxh64_digest, found, repeat(42))), dtype=np.int64))


def set_ids(found: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two independent hashes of a set; of the first only as many bits as asked for (fewer in tests)."""
    from xxhash import xxh64_intdigest

    first, second = (np.uint64(xxh64_intdigest(found.tobytes(), seed)) for seed in (0, 1))
    return int((first >> np.uint64(64 - bits)).view(np.int64)), int(second.view(np.int64))


def set_id(found: np.ndarray, shared: frozenset[int] = frozenset(), bits: int = 64) -> int:
    """The first hash of a set, or the second one where the first is ``shared`` by unlike sets."""
    first, second = set_ids(found, bits)
    return second if first in shared else first


def prefix(found: np.ndarray, similarity: float, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set: as many as leave no pair of the similarity without one in common.
    ``frequent`` (ascending) come last, by ``rank``."""
    n = len(found)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        found = found[np.lexsort((found, np.where(frequent[at] == found, rank[at] + 1, 0)))]
    return found[: n - int(np.ceil(similarity * n - SLACK)) + 1]


def needed(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """What sets of n and m shingles have in common at least if they have the similarity."""
    return similarity / (1 + similarity) * (n + m) - SLACK


def _flat(batch_sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(x) for x in batch_sets]
    return np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.empty(0, np.int64), *batch_sets])


def set_fingerprint(found: np.ndarray) -> int:
    """SimHash of a set, as a signed long."""
    return int(np.uint64(over_half(found.view(np.uint8).reshape(-1, 8))).view(np.int64)) if len(found) else 0


def marked_sets(docs: DataFrame, size: int, bits: int = 64) -> DataFrame:
    """doc_id, key (a hash of the text), ``sid`` and ``second`` (hashes of the set), n (its size) and
    ``sketch`` of every row."""
    names = ["doc_id", "key", "sid", "second", "n", "sketch"]
    types = [docs.schema["doc_id"].dataType, T.LongType(), T.LongType(), T.LongType(), T.IntegerType(), T.BinaryType()]
    fields = [T.StructField(name, of) for name, of in zip(names, types, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            sets = [shingles(t.as_py(), size) for t in batch.column(2)]
            ids = np.array([set_ids(x, bits) for x in sets], dtype=np.int64).reshape(-1, 2)
            new = [pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(map(len, sets), pa.int32()), pa.array(map(sketch, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=names)

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, T.StructType(fields))


def shared_ids(marked: DataFrame) -> frozenset[int]:
    """First hashes that unlike sets have in common, so that these are told apart by the second one. Of m
    sets about m^2 / 2^65 share one (70 of 5e10), which is what reaches the driver."""
    both = marked.groupBy("sid").agg(F.min("second").alias("lo"), F.max("second").alias("hi"))
    return frozenset(r["sid"] for r in both.where("lo <> hi").select("sid").collect())


def frequent_shingles(docs: DataFrame, size: int, n_rows: int, sample_rows: int = 20_000, least: int = 3, limit: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts of a sample of about ``sample_rows``, ascending, and their rank by
    count."""
    step = max(1, n_rows // sample_rows)
    part = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(step)) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_flat([shingles(t.as_py(), size) for t in batch.column(0)])[1])], names=["h"])

    top = part.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(limit).collect()
    values = np.array([r["h"] for r in reversed(top)], dtype=np.int64)
    order = np.argsort(values)
    return values[order], order


def prefixes(docs: DataFrame, size: int, similarity: float, frequent: tuple[np.ndarray, np.ndarray], shared: frozenset[int] = frozenset(), bits: int = 64) -> DataFrame:
    """h, n (size of the set), sid, pos and fp for every shingle of every set's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            sets = [shingles(t.as_py(), size) for t in batch.column(0)]
            sets = [x for x in sets if len(x)]
            first = [prefix(x, similarity, *frequent) for x in sets]
            row, h = _flat(first)
            n, sid, fp = (np.array(list(map(of, sets)), dtype=t) for of, t in ((len, np.int32), (lambda x: set_id(x, shared, bits), np.int64), (set_fingerprint, np.int64)))
            pos = np.concatenate([np.empty(0, np.int32), *(np.arange(len(x), dtype=np.int32) for x in first)])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n[row]), pa.array(sid[row]), pa.array(pos), pa.array(fp[row])], names=["h", "n", "sid", "pos", "fp"])

    return docs.select("text").mapInArrow(run, "h long, n int, sid long, pos int, fp long")


class Pairs:
    """Collects the candidate pairs (a, b), a < b, of set ids among rows of a bucket."""

    def __init__(self, n: np.ndarray, sid: np.ndarray, pos: np.ndarray, similarity: float):
        self.n, self.sid, self.pos, self.similarity = n.astype(np.int64), sid, pos, similarity
        self.found = [np.empty((0, 2), dtype=np.int64)]

    def near(self, rows: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether sizes and places in the prefix leave it open that sets are similar."""
        n, pos = self.n, self.pos
        left = np.minimum(pos[rows], pos[other]) + np.minimum(n[rows] - pos[rows], n[other] - pos[other])
        return (left >= needed(n[rows], n[other], self.similarity)) & (self.sid[rows] != self.sid[other])

    def add(self, rows: np.ndarray, other: np.ndarray) -> None:
        a, b = self.sid[rows], self.sid[other]
        self.found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))

    def all(self) -> np.ndarray:
        return np.unique(np.concatenate(self.found), axis=0)


def neighbouring(bucket: np.ndarray, n: np.ndarray, sid: np.ndarray, pos: np.ndarray, fp: np.ndarray, similarity: float, radius: int) -> np.ndarray:
    """Candidates among rows sorted by bucket and n: each with the two before it in its bucket."""
    pairs = Pairs(n, sid, pos, similarity)
    for back in (1, 2):
        rows = np.arange(back, len(sid))
        before = rows - back
        good = (bucket[rows] == bucket[before]) & (n[before] >= similarity * n[rows] - SLACK)
        rows, before = rows[good], before[good]
        differ = np.bitwise_count((fp[rows] ^ fp[before]).view(np.uint64))
        good = pairs.near(rows, before) & ((differ <= radius) | (n[before] < SHORT))
        pairs.add(rows[good], before[good])
    return pairs.all()


def apart(bucket: np.ndarray, n: np.ndarray, pos: np.ndarray, fp: np.ndarray, root: np.ndarray, similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the candidates of different roots among rows sorted by bucket and n. A pair may
    be left out of buckets other than that of the first shingle that both have in the common order: after it
    come all others that they share."""
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    one = np.minimum.reduceat(root, starts) == np.maximum.reduceat(root, starts)
    at = np.flatnonzero(np.repeat(~one, np.diff(np.append(starts, len(bucket)))))
    bucket, n, pos, fp, root = (x[at] for x in (bucket, n.astype(np.int64), pos, fp, root))
    out = []

    def add(rows: np.ndarray, other: np.ndarray) -> None:
        left = np.minimum(n[rows] - pos[rows], n[other] - pos[other])
        good = (left >= needed(n[rows], n[other], similarity)) & (root[rows] != root[other])
        out.append((at[rows[good]], at[other[good]]))

    # The short sets, each against those of its bucket that aren't too long for it.
    rows, ahead = np.flatnonzero(n < SHORT), 0
    while len(rows):
        ahead += 1
        rows = rows[rows + ahead < len(n)]
        other = rows + ahead
        near = (bucket[rows] == bucket[other]) & (n[rows] >= similarity * n[other] - SLACK)
        rows, other = rows[near], other[near]
        add(rows, other)
    # All others by their fingerprints, in buckets of several.
    rows = np.flatnonzero(n >= SHORT)
    same = bucket[rows][1:] == bucket[rows][:-1]
    rows = rows[np.append(False, same) | np.append(same, False)] if len(rows) else rows
    if len(rows):
        starts = np.flatnonzero(np.append(True, bucket[rows][1:] != bucket[rows][:-1]))
        i, j = linked(fp[rows].view(np.uint64), starts, radius)
        add(rows[i], rows[j])
    i, j = zip(*out, strict=True) if out else ((), ())
    return np.concatenate([at[:0], *i]), np.concatenate([at[:0], *j])


def _first_pass(similarity: float, radius: int, split: int):
    """Reads rows (h, n, sid, pos, fp) sorted in this order, and yields for every bucket h the neighbouring
    candidates (a, b). Buckets that may hold more, of over two sets, come out as rows too: with b null and the
    other columns filled in. Of a bucket over ``split`` only as many rows are held at once."""
    names = ["a", "b", "h", "n", "pos", "fp"]

    def pairs(part: list[np.ndarray], bucket: np.ndarray) -> pa.RecordBatch:
        found = neighbouring(bucket, *part[1:], similarity, radius)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), *(pa.nulls(len(found), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=names)

    def rows(part: list[np.ndarray]) -> pa.RecordBatch:
        h, n, sid, pos, fp = part
        return pa.RecordBatch.from_arrays([pa.array(sid), pa.nulls(len(sid), pa.int64()), pa.array(h), pa.array(n), pa.array(pos), pa.array(fp)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        hot = None  # the shingle of an open bucket whose rows go out as they come
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            kept = [np.concatenate(x) for x in zip(kept, new, strict=True)] if kept else new
            if not len(kept[0]):
                continue
            again = (kept[0][1:] == kept[0][:-1]) & (kept[2][1:] == kept[2][:-1])  # rows of one set: copies
            kept = [x[np.append(True, ~again)] for x in kept]
            bucket = np.cumsum(np.append(False, kept[0][1:] != kept[0][:-1]))
            sizes = np.bincount(bucket)
            out = (bucket < bucket[-1]) | (sizes[-1] > split) | (hot is not None and kept[0][-1] == hot)
            if out.any():
                done = [x[out] for x in kept]
                yield pairs(done, bucket[out])
                several = (sizes > 2)[bucket[out]] | (done[0] == hot if hot is not None else False)
                if several.any():
                    yield rows([x[several] for x in done])
            hot = kept[0][-1] if out[-1] else None
            kept = [x[~out] for x in kept]
        if kept and len(kept[0]):
            yield pairs(kept, np.zeros(len(kept[0]), np.int64))
            if len(kept[0]) > 2:
                yield rows(kept)

    return run


#: Columns of the second pass: a row of a bucket h in the unit (h, lo, hi), sorted by the first five.
ROW = "h long, lo int, hi int, n int, sid long, pos int, fp long, root long"


def _whole_units(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The columns of whole units (the first three columns), with the number of each row's unit; so many
    units at once that these have about ``most`` pairs, and one at least."""

    def dealt(part: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        unit = np.cumsum(np.append(False, np.any([x[1:] != x[:-1] for x in part[:3]], axis=0)))
        turn = (np.cumsum(np.bincount(unit).astype(np.int64) ** 2) // most)[unit]
        cuts = [0, *(np.flatnonzero(turn[1:] != turn[:-1]) + 1), len(unit)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield unit[a:b], [x[a:b] for x in part]

    kept: list[np.ndarray] = []
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        kept = [np.concatenate(x) for x in zip(kept, new, strict=True)] if kept else new
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in kept[:3]], axis=0))
        if len(change):
            yield from dealt([x[: change[-1] + 1] for x in kept])
            kept = [x[change[-1] + 1 :] for x in kept]
    if kept and len(kept[0]):
        yield from dealt(kept)


def _near_rows(similarity: float, radius: int):
    """Of rows (``ROW``) those that have a candidate of a different root in their unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, part in _whole_units(batches):
            i, j = apart(unit, part[3], *part[5:8], similarity, radius)
            yield _picked(part, np.unique(np.concatenate([i, j])))

    return run


def _open_rows(similarity: float, radius: int, chunk: int = 1 << 16):
    """Of rows (``ROW`` and a sketch) those that have a candidate of a different root in their unit that the
    sketches leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, part in _whole_units(batches):
            i, j = apart(unit, part[3], *part[5:8], similarity, radius)
            seen = np.zeros(len(unit), dtype=bool)
            for k in range(0, len(i), chunk):
                a, b = i[k : k + chunk], j[k : k + chunk]
                new = ~(seen[a] & seen[b])
                a, b = a[new], b[new]
                good = room(part[8], part[3], a, b, similarity) >= 0
                seen[a[good]] = seen[b[good]] = True
            yield _picked(part, np.flatnonzero(seen))

    return run


def _picked(part: list[np.ndarray], rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in part[:8]], names=[f.split()[0] for f in ROW.split(", ")])


def _linked_rows(similarity: float, radius: int, chunk: int = 1 << 16):
    """Of rows (``ROW`` and the whole sets as bytes) links (a, b) that connect what is linked in a unit and has
    different roots: a forest, less than one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, part in _whole_units(batches):
            sid, sets = part[4], [np.frombuffer(x, dtype=np.int64) for x in part[8]]
            sketches = np.array([*map(sketch, sets), None], dtype=object)[:-1]
            i, j = apart(unit, part[3], *part[5:8], similarity, radius)
            label = np.unique(np.stack([unit, part[7]], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
            links = []
            for k in range(0, len(i), chunk):
                a, b = i[k : k + chunk], j[k : k + chunk]
                new = label[a] != label[b]
                a, b = a[new], b[new]
                left = room(sketches, part[3], a, b, similarity)
                for at in np.argsort(-left):
                    x, y = a[at], b[at]
                    if left[at] < 0:
                        break
                    if label[x] != label[y] and similar(sets[x], sets[y], similarity):
                        label[label == label[x]] = label[y]
                        links.append((sid[x], sid[y]))
            found = np.array(links, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], names=["a", "b"])

    return run


def first_candidates(rows: DataFrame, similarity: float, split: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (prefixes) the neighbouring candidates (a, b), and the rows of the buckets that may hold
    more (h, n, sid, pos, fp)."""
    out = "a long, b long, h long, n int, pos int, fp long"
    found, _ = stored(rows.repartition("h").select("h", "n", "sid", "pos", "fp").sortWithinPartitions("h", "n", "sid").mapInArrow(_first_pass(similarity, radius, split), out))
    pairs, _ = stored(found.where("b is not null").select("a", "b").distinct())
    return pairs, found.where("b is null").select("h", "n", F.col("a").alias("sid"), "pos", "fp").distinct()


def further_links(rows: DataFrame, roots: DataFrame, docs: DataFrame, marked: DataFrame, size: int, similarity: float, split: int, radius: int) -> DataFrame:
    """Edges (a, b) that connect what is linked among ``rows`` and has different roots (sid, root; others are
    their own). Buckets are dealt into parts of about ``split`` rows, fewer of long sets, and each pair of parts
    is one unit, whose sets are compared where they meet."""
    named = rows.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    parts = F.ceil(F.greatest((F.count(F.lit(1)) + 1) / split, F.sum("n") / (2048 * split))).cast("int")
    sizes = named.groupBy("h").agg(parts.alias("parts"), F.min("root").alias("x"), F.max("root").alias("y"))
    mixed = named.join(sizes.where("x <> y").select("h", "parts"), "h").withColumn("own", F.pmod(F.xxhash64("sid", F.lit(7)), F.col("parts")).cast("int"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("own")))
    columns = ["h", "lo", "hi", "n", "sid", "pos", "fp", "root"]
    dealt = mixed.withColumn("other", F.explode(others)).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).select(*columns)

    def met(part: DataFrame, step, out: str) -> DataFrame:
        return part.repartition(*columns[:3]).sortWithinPartitions(*columns[:5]).mapInArrow(step(similarity, radius), out)

    near, near_path = stored(met(dealt, _near_rows, ROW))
    if near.isEmpty():
        return near.select(F.col("sid").alias("a"), F.col("sid").alias("b"))
    sids, _ = stored(near.select("sid").distinct())
    sketches = marked.join(sids, "sid", "left_semi").select("sid", "sketch").dropDuplicates(["sid"])
    left, left_path = stored(met(near.join(sketches, "sid").select(*columns, "sketch"), _open_rows, ROW))
    remove(docs.sparkSession, near_path)
    sids, _ = stored(left.select("sid").distinct())
    sets, sets_path = stored(sets_of(docs, sids, marked, size))
    edges = checkpointed(met(left.join(sets, "sid").select(*columns, "words"), _linked_rows, "a long, b long").distinct())
    remove(docs.sparkSession, left_path)
    remove(docs.sparkSession, sets_path)
    return edges


def sketch(found: np.ndarray) -> bytes:
    """How many shingles of a set begin with each value of as many bits as number them: a byte each. Empty
    where a byte can't hold a count."""
    bits = max(6, int(len(found) - 1).bit_length())
    counts = np.bincount((found.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_reach(x: bytes, y: bytes, n: int, m: int, similarity: float) -> bool:
    """Whether sketches leave it open that sets of n and m shingles have the similarity: these can't have
    more in common than the sum of the lesser counts."""
    if not x or not y:
        return True
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    size = min(len(a), len(b))
    both = int(np.minimum(a.reshape(size, -1).sum(axis=1), b.reshape(size, -1).sum(axis=1)).sum())
    return both >= needed(n, m, similarity)


def room(sketches: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float, chunk: int = 1 << 22) -> np.ndarray:
    """For pairs of rows (i, j) how far the most that the sets can have in common by their sketches lies over
    what the similarity needs: negative where ``may_reach`` is false, infinite where a sketch is empty."""
    lengths = np.array([*map(len, sketches)], dtype=np.int64)
    out = np.full(len(i), np.inf)
    small, large = np.minimum(lengths[i], lengths[j]), np.maximum(lengths[i], lengths[j])
    for size in np.unique(small[small > 0]):
        folded, place = {}, np.zeros(len(lengths), dtype=np.int64)
        for length in np.unique(large[small == size]).tolist() + [int(size)]:
            rows = np.flatnonzero(lengths == length)
            place[rows] = np.arange(len(rows))
            counts = np.frombuffer(b"".join(sketches[rows]), np.uint8).reshape(len(rows), size, -1)
            folded[length] = counts[:, :, 0] if length == size else counts.sum(axis=2, dtype=np.uint32)
        for length in folded:
            at = np.flatnonzero((small == size) & (large == length))
            x = np.where(lengths[i[at]] == size, i[at], j[at])
            y = i[at] + j[at] - x
            step = max(1, chunk // int(size))
            for k in range(0, len(at), step):
                part = slice(k, k + step)
                both = np.minimum(folded[int(size)][place[x[part]]], folded[length][place[y[part]]]).sum(axis=1, dtype=np.int64)
                out[at[part]] = both - needed(n[x[part]].astype(np.int64), n[y[part]], similarity)
    return out


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether sets have the similarity or more."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - SLACK


def members(pairs: DataFrame) -> DataFrame:
    """The set ids (sid) of pairs, as a file: while they are few, Spark broadcasts them."""
    return stored(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct())[0]


def sets_of(docs: DataFrame, sids: DataFrame, marked: DataFrame, size: int) -> DataFrame:
    """sid and ``words`` (the set as bytes) of the given sets, each from one of its texts."""
    keys, _ = stored(marked.join(sids, "sid").groupBy("sid").agg(F.min("key").alias("key")))
    texts = docs.select(F.xxhash64("text").alias("key"), "text").join(keys, "key").dropDuplicates(["key"]).select("sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            words = pa.array([shingles(t.as_py(), size).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), words], names=["sid", "words"])

    return texts.mapInArrow(run, "sid long, words binary")


def likely(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the sets' sketches (sid, n, sketch) leave open: an eighth of the sets' bytes or
    so is moved instead of the sets, and few pairs that aren't linked are left."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("n1"), F.col("sketch").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            keep = pa.array([may_reach(x.as_py(), y.as_py(), n, m, similarity) for x, y, n, m in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "n1", "n2").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity or more."""
    left = sets.select(F.col("sid").alias("a"), F.col("words").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("words").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            sets = [[np.frombuffer(v.as_py(), dtype=np.int64) for v in batch.column(k)] for k in (2, 3)]
            keep = pa.array([similar(x, y, similarity) for x, y in zip(*sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def roots_of(edges: DataFrame) -> DataFrame:
    """sid and root of every set of the edges."""
    parts = connected_components(edges)
    return checkpointed(parts.unionByName(parts.select(F.col("root").alias("node"), "root")).distinct().withColumnRenamed("node", "sid"))


def settled(pairs: DataFrame, docs: DataFrame, marked: DataFrame, size: int, similarity: float) -> DataFrame:
    """The edges (a, b) of the similarity among ``pairs``. What is written on the way is deleted."""
    sketches = marked.join(members(pairs), "sid", "left_semi").select("sid", "n", "sketch").dropDuplicates(["sid"])
    left, left_path = stored(likely(pairs, sketches, similarity))
    sets, sets_path = stored(sets_of(docs, members(left), marked, size))
    edges = checkpointed(verified(left, sets, similarity))
    remove(docs.sparkSession, left_path)
    remove(docs.sparkSession, sets_path)
    return edges


def links(docs: DataFrame, marked: DataFrame, size: int = 5, similarity: float = 0.8, split: int = 1024, radius: int = RADIUS, shared: frozenset[int] = frozenset(), bits: int = 64) -> DataFrame:
    """Edges (a, b) between set ids that connect whatever pairs of the similarity connect, and nothing else:
    from each set of the first pass to its root, and those of the second."""
    frequent = frequent_shingles(docs, size, marked.count())
    pairs, more = first_candidates(prefixes(docs, size, similarity, frequent, shared, bits), similarity, split, radius)
    edges = settled(pairs, docs, marked, size, similarity)
    roots = roots_of(edges)
    stars = roots.where("sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b"))
    return stars.unionByName(further_links(more, roots, docs, marked, size, similarity, split, radius))


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, split: int = 1024, radius: int = RADIUS, bits: int = 64) -> DataFrame:
    """doc_id, key, component_id (the smallest doc_id of all documents reachable over links) and root, a
    set id that names the component."""
    marked, _ = stored(marked_sets(docs, size, bits))
    shared = shared_ids(marked)
    if shared:
        marked = marked.withColumn("sid", F.when(F.col("sid").isin(list(shared)), F.col("second")).otherwise(F.col("sid")))
    parts = connected_components(links(docs, marked, size, similarity, split, radius, shared, bits))
    named = marked.join(parts.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    low = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(low, "root").select("doc_id", "key", "component_id", "root")


def deduplicated(docs: DataFrame, size: int = 5, similarity: float = 0.8, split: int = 1024, radius: int = RADIUS) -> DataFrame:
    """The columns of ``docs`` for one document of each group, as ``simhash.deduplicated`` does."""
    return kept_rows(docs, near_copies(docs, size, similarity, split, radius))
