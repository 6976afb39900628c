import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mailjobs.llm import simhash as S


def plain(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", None, " \n", "One", "one TWO", "Ä b c", "a b c d e f g a b c", "x " * 500])
def test_fingerprint(text):
    assert S.fingerprint(text) == plain(text)


def test_spark_hashes_alike(one):
    assert one(F.xxhash64(F.lit("a b c"))) & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def flipped(rng, centre, n, most):
    out = []
    for _ in range(n):
        x = centre
        for b in rng.choice(64, rng.integers(0, most + 1), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return out


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_bit_sliced_pairs_equal_brute_force(radius, chunk):
    rng = np.random.default_rng(radius)
    buckets = [flipped(rng, int(rng.integers(1 << 62)), n, 6) for n in (1, 2, 63, 64, 65, 200, 1, 130)]
    fps = np.array([x for b in buckets for x in b], dtype=np.uint64)
    starts = np.cumsum([0] + [len(b) for b in buckets[:-1]])
    i, j = S.linked(fps, starts, radius, chunk)
    want = set()
    for a, b in zip(starts, [*starts[1:], len(fps)], strict=True):
        want |= {(p, q) for p in range(a, b) for q in range(p + 1, b) if (int(fps[p]) ^ int(fps[q])).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_masks_find_all_pairs(blocks):
    rng = np.random.default_rng(0)
    masks = S.block_masks(blocks, 3)
    for _ in range(500):
        x, y = flipped(rng, int(rng.integers(1 << 62)), 1, 0)[0], 0
        y = flipped(rng, x, 1, 3)[0]
        assert any(x & m == y & m for m in masks)
    assert S.choose_blocks(1000, 3) == 4 and S.choose_blocks(10**9, 3) > 4


def components(fps):
    u = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    label = np.arange(len(u))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize(("split", "blocks"), [(1024, 4), (16, 4), (16, 6)])
def test_components_equal_brute_force(spark, split, blocks):
    """Dense groups, chains, and buckets that are dealt out in parts."""
    rng = np.random.default_rng(5)
    fps = list(dict.fromkeys(flipped(rng, 12345678901234567, 150, 4) + [int(x) for x in rng.integers(1 << 62, size=100)]))
    chain = [int(rng.integers(1 << 62))]
    for _ in range(30):
        chain.append(flipped(rng, chain[-1], 1, 3)[0])
    fps = list(dict.fromkeys(fps + chain))
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    edges = S.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5), 3, split, blocks)
    root = {r["node"]: r["root"] for r in S.connected_components(edges).collect()}
    got = [root.get(x, x) for x in signed]
    want = components(fps)
    groups = lambda labels: sorted(tuple(k for k, x in enumerate(labels) if x == y) for y in set(labels))
    assert groups(got) == groups(want.tolist())


def test_near_duplicates_equal_brute_force(docs):
    rows = {r["doc_id"]: r for r in S.near_duplicates(docs).collect()}
    ids = sorted(rows)
    fps = [rows[i]["fp"] & (2**64 - 1) for i in ids]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert fps == [plain(texts[i]) for i in ids]
    label = components(fps)
    assert [rows[i]["component_id"] for i in ids] == [ids[k] for k in label]


def test_odd_rows(odd, empty):
    got = S.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = [r["component_id"] for r in got if r["fp"] == 0]
    assert set(zero) == {3}  # null, empty and blank texts link
    assert [r["component_id"] for r in got if r["doc_id"] in (1, 2)] == [1, 1, 1]
    assert S.near_duplicates(empty).count() == 0


def test_one_document_of_each_group_stays(spark, odd, docs):
    kept = S.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    groups = {r["component_id"] for r in S.near_duplicates(odd).collect()}
    assert ids == sorted((g is None, g or 0) for g in groups)  # repeated rows and copies once
    want = {r["component_id"] for r in S.near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in S.deduplicated(docs).collect()) == sorted(want)
    none = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "quite another text here")], "doc_id long, text string")
    assert S.deduplicated(none).count() == 2
    twice = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five SIX"), (7, "quite another text here")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in S.deduplicated(twice).collect()) == [1, 7]
