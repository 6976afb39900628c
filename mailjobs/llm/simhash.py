"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64-bit SimHashes of word shingles. Two distinct fingerprints within the radius must
agree on at least one choice of blocks of bits (pigeonhole), so every pair is found in some bucket of
equal blocks, exactly. Inside a bucket fingerprints are stored vertically: word p of a block holds bit
p of 64 fingerprints. A fingerprint is compared with 64 others at once by XOR of its bit with the
plane; carry-save counters, themselves bit-sliced, add the differences, and a block is abandoned once
all of its 64 counters exceed the radius.

Scale: equal fingerprints collapse before anything is joined, buckets of more than ``split`` rows are
dealt out as pairs of parts, each task returns a spanning forest of what it linked (never all pairs),
and components are found with star contractions on checkpointed edges.

Defined results: a null text or one without a word has fingerprint zero and links like any other;
repeated rows give repeated rows; a null doc_id is never a component_id unless its whole component
has none; columns beyond doc_id and text take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, short

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Row i: the bits of byte value i, lowest first.
BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)

_words = re.compile(rb"[^\x20\x09-\x0D]+").findall
_lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """SimHash of the XXH64 of all word shingles, repeats included, A-Z lower-cased."""
    from xxhash import xxh64_digest

    words = _words((text or "").encode().translate(_lower))
    if not words:
        return 0
    if len(words) < size:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return over_half(np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(seed))), dtype=np.uint8).reshape(-1, 8))


def over_half(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, rows of eight bytes, highest first."""
    set_bits = np.concatenate([np.bincount(hashes[:, 7 - k], minlength=256) @ BITS for k in range(8)])
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, key (a hash of the text) and ``fp`` (the fingerprint as a signed long) of every row; one
    narrow stage."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            found = np.array([fingerprint(t.as_py(), size, seed) for t in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "key", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, schema)


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of which any two values within ``radius`` bits agree on one: the bits are cut into
    ``blocks`` runs, and each mask takes all but ``radius`` of them."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    runs = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(runs, blocks - radius)]


def choose_blocks(n: int, radius: int) -> int:
    """As few blocks as keep a bucket of random fingerprints near 64 rows: longer keys, but more of
    them, for more rows."""
    blocks = radius + 1
    while blocks < radius + 4 and n >> min(m.bit_count() for m in block_masks(blocks, radius)) > 64:
        blocks += 1
    return blocks


def linked(fps: np.ndarray, starts: np.ndarray, radius: int = 3, chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j), i < j, of all pairs within ``radius`` inside the buckets that begin at
    ``starts`` (ascending, first 0)."""
    n = len(fps)
    sizes = np.diff(np.append(starts, n))
    first = np.repeat(starts, sizes)
    local = np.arange(n) - first
    n_blocks = -(-sizes // 64)
    block_of = np.repeat(np.cumsum(n_blocks) - n_blocks, sizes) + local // 64
    block_start = np.flatnonzero(local % 64 == 0)
    lane = (local % 64).astype(np.uint64)
    planes = np.empty((64, len(block_start)), dtype=np.uint64)
    for p in range(64):
        planes[p] = np.bitwise_or.reduceat((fps >> np.uint64(p) & np.uint64(1)) << lane, block_start)
    block_size = np.diff(np.append(block_start, n))
    present = ALL >> (64 - block_size).astype(np.uint64)

    rest = np.repeat(n_blocks, sizes) - local // 64  # blocks from its own to the bucket's last
    rest[np.repeat(sizes, sizes) < 2] = 0
    n_counters = max(1, int(radius).bit_length())
    preset = (1 << n_counters) - (radius + 1)
    out_i, out_j = [], []
    cuts = np.cumsum(rest)
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(cuts, (cuts[begin - 1] if begin else 0) + chunk, side="right")))
        rows = np.repeat(np.arange(begin, end), rest[begin:end])
        ahead = np.arange(len(rows)) - np.repeat(np.cumsum(rest[begin:end]) - rest[begin:end], rest[begin:end])
        begin = end
        blocks = block_of[rows] + ahead
        own = ahead == 0
        over = ~present[blocks]
        over[own] |= ALL >> (np.uint64(63) - lane[rows[own]])  # itself and those before it
        values = fps[rows]
        counters = [np.full(len(rows), ALL if preset >> c & 1 else 0, dtype=np.uint64) for c in range(n_counters)]
        for p in range(64):
            carry = planes[p][blocks] ^ (np.uint64(0) - (values >> np.uint64(p) & np.uint64(1)))
            for c in range(n_counters):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            over |= carry
            if p % 8 == 7:
                alive = over != ALL
                if not alive.all():
                    rows, blocks, values, over = rows[alive], blocks[alive], values[alive], over[alive]
                    counters = [x[alive] for x in counters]
                if not len(rows):
                    break
        hits = ~over
        while len(rows):
            low = hits & (np.uint64(0) - hits)
            out_i.append(rows)
            out_j.append(block_start[blocks] + np.bitwise_count(low - np.uint64(1)).astype(np.int64))
            hits = hits ^ low
            more = hits != 0
            rows, blocks, hits = rows[more], blocks[more], hits[more]
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.empty(0, np.int64), np.empty(0, np.int64))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row number that each of ``n`` rows is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _link_partition(radius: int):
    """Reads rows sorted by bucket and yields edges of a spanning forest of each bucket."""

    def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        values = fp.view(np.uint64)
        i, j = linked(values, starts, radius)
        label = forest(len(fp), i, j)
        odd = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[odd]), pa.array(fp[label[odd]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept_fp = np.empty((0, 4), np.int64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([kept_key, np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)])
            fp = np.concatenate([kept_fp, batch.column(4).to_numpy(zero_copy_only=False)])
            change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
            cut = int(change[-1]) + 1 if len(change) else 0  # the last bucket may go on
            if cut:
                yield edges(key[:cut], fp[:cut])
            kept_key, kept_fp = key[cut:], fp[cut:]
        if len(kept_fp):
            yield edges(kept_key, kept_fp)

    return run


def links(distinct: DataFrame, radius: int = 3, split: int = 1024, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that connect whatever is within
    ``radius``, directly or in steps. Pairs of different texts are all reachable through them."""
    blocks = blocks or choose_blocks(distinct.count(), radius)
    masks = block_masks(blocks, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("m")) for k, m in enumerate(signed))))
    keyed = distinct.select("fp", keys.alias("k")).select("fp", "k.t", "k.m")
    # Buckets over the limit: their rows are dealt into parts, and each pair of parts is one task.
    hot = checkpointed(keyed.groupBy("t", "m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).withColumn("parts", F.ceil(F.col("n") / split).cast("int")).drop("n"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    others = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("own")))
    dealt = (
        keyed.join(hot, ["t", "m"], "left")
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("other", F.explode(others))
        .select("t", "m", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    spark = distinct.sparkSession
    cols = ["t", "m", "lo", "hi"]
    edges = dealt.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(_link_partition(radius), "a long, b long")
    out = checkpointed(edges.distinct())
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): alternating large and small stars, each a
    partial aggregation and a join, until nothing changes; root is the smallest node."""
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpointed(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        now = checkpointed(small)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark


def near_duplicates(docs: DataFrame, size: int = 3, seed: int = 42, radius: int = 3, split: int = 1024) -> DataFrame:
    """doc_id, key, fp, component_id (the smallest doc_id of all documents reachable over links) and root,
    a fingerprint that names the component."""
    marked = checkpointed(fingerprints(docs, size, seed))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = connected_components(links(distinct.select("fp"), radius, split))
    # Only fingerprints in a component of several need another look; they are few beside the rows.
    member = parts.select(F.col("node").alias("fp"), "root").unionByName(parts.select(F.col("root").alias("fp"), "root").distinct())
    member = checkpointed(member.join(distinct, "fp"))
    low = member.groupBy("root").agg(F.min("first").alias("low"))
    several = member.join(low, "root").select("fp", "root", "low")
    # A component with a root has its smallest id in low, which is null only if none of its rows has an id.
    component = F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("low"))
    known = checkpointed(distinct.join(several, "fp", "left").select("fp", component.alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return marked.join(known, "fp").select("doc_id", "key", "fp", "component_id", "root")


def deduplicated(docs: DataFrame, size: int = 3, seed: int = 42, radius: int = 3, split: int = 1024) -> DataFrame:
    """The columns of ``docs`` for one document of each group: the one whose doc_id is the component's.

    Repeated rows stay once. Of texts that share that doc_id, and of those of a group in which none has
    one, the one with the smallest hash stays. Texts are shuffled once, by what identifies a document.
    """
    return kept_rows(docs, near_duplicates(docs, size, seed, radius, split))


def kept_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One document of each of the groups (doc_id, key, component_id, root), as in ``deduplicated``."""
    names = ["__id", "__key"]
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    chosen = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("key").alias("__key"), F.first(ident).alias("__id"))
    rows = docs.withColumn("__id", ident).withColumn("__key", F.xxhash64("text"))
    return rows.join(chosen.select(*names), names, "left_semi").dropDuplicates(names).select(*docs.columns)
