import random

import pytest

import corpus_pipeline as C
from mailjobs.llm import nearcopies as N
from mailjobs.llm import simhash


def brute(rows, similarity=0.8):
    """The smallest id of each id's group, by all pairs of 5-word sets."""
    words = {i: simhash._words((t or "").encode().translate(simhash._lower)) for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    label = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def edited():
    """Texts, copies with a few words changed, dropped or added, and texts close under the similarity."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    frame = [rng.choice(words) for _ in range(40)]
    out = []
    for _ in range(12):
        text = [*frame, *(rng.choice(words) for _ in range(rng.choice([8, 60, 300])))]
        out.append(" ".join(text))
        for _ in range(6):
            copy = list(text)
            for _ in range(rng.randrange(1, 2 + len(text) // 30)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
            out.append(" ".join(copy))
    return [*enumerate([*out, "a b c", "A  b c", "", None])]


@pytest.mark.parametrize("split", [4, 1024])
def test_groups_equal_brute_force(spark, split):
    rows = edited()
    want = brute(rows)
    assert 20 < len(set(want.values())) < 70
    got = {r["doc_id"]: r["component_id"] for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), split=split).collect()}
    assert got == want


def test_radius_of_64_is_the_exact_way(spark):
    rows = edited()
    got = N.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), radius=64).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows)


@pytest.mark.parametrize("bits", [1, 5])
def test_unlike_sets_of_one_hash_are_told_apart(spark, bits):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(N.shared_ids(N.marked_sets(docs, 5, bits))) > 1
    got = N.near_copies(docs, bits=bits).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows)


def test_groups_of_near_copies_list_pairs_in_proportion(spark, monkeypatch):
    """Candidates of all passes grow with the rows of a group, not with its pairs."""
    counts, plain = [], N.likely

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(N, "likely", counted)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    text = [rng.choice(words) for _ in range(300)]
    totals = []
    for m in (250, 1000):
        rows = []
        for k in range(m):
            copy = list(text)
            for at in rng.sample(range(300), 3):
                copy[at] = rng.choice(words)
            rows.append((k, " ".join(copy)))
        counts.clear()
        got = N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["component_id"] for r in got} == {0} and len(got) == m
        totals.append(sum(counts))
    assert totals[1] < 40 * 1000 and totals[1] < 8 * totals[0]


def test_stage_equals_brute_force(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = C.near_duplicates(spark, docs, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, low in want.items() if i == low)


def test_sketches_rule_out_no_pair_of_the_similarity():
    import numpy as np

    from mailjobs.llm import nearcopies as N

    rng = np.random.default_rng(6)
    ruled_out = 0
    for _ in range(300):
        x = np.unique(rng.integers(-(1 << 63), 1 << 63, rng.integers(1, 400), dtype=np.int64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.choice([0.3, 0.9])], rng.integers(-(1 << 63), 1 << 63, rng.integers(0, 60), dtype=np.int64)]))
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        open_ = N.may_reach(N.sketch(x), N.sketch(y), len(x), len(y), 0.8)
        assert open_ or both < 0.8 * (len(x) + len(y) - both)
        ruled_out += not open_
    assert ruled_out > 50
    assert N.sketch(np.arange(1000, dtype=np.int64)) == b"" and N.may_reach(b"", b"", 1, 9, 0.8)


def test_groups_that_miss_the_similarity_hand_on_rows_in_proportion(spark, monkeypatch):
    """Copies with so many edits that only some of them link: nothing that is written or compared in a join
    grows with the pairs of such a group, and the groups are those of all pairs."""
    counts, plain = [], N.stored

    def counted(df):
        out = plain(df)
        counts.append(out[0].count())
        return out

    monkeypatch.setattr(N, "stored", counted)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    text = [rng.choice(words) for _ in range(150)]
    most = []
    for m in (100, 400):
        rows = []
        for k in range(m):
            copy = list(text)
            for at in rng.sample(range(150), rng.choice([2, 3])):
                copy[at] = rng.choice(words)
            rows.append((k, " ".join(copy)))
        counts.clear()
        got = {r["doc_id"]: r["component_id"] for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        want = brute(rows)
        assert got == want and 5 < len(set(want.values())) < m
        most.append(max(counts))
    assert most[1] < 6 * most[0]


def test_sketches_of_pairs_at_once_are_those_of_each():
    import numpy as np

    rng = np.random.default_rng(8)
    sets = []
    for n in (1, 40, 64, 65, 90, 128, 140, 300):
        base = np.unique(rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64))
        sets += [base, np.unique(np.append(base[: max(1, 9 * n // 10)], rng.integers(-(1 << 63), 1 << 63, n // 5, dtype=np.int64)))]
    sets.append(np.arange(1000, dtype=np.int64))
    i, j = np.triu_indices(len(sets), 1)
    sketches, n = np.array([N.sketch(x) for x in sets], dtype=object), np.array([*map(len, sets)])
    for chunk in (1, 1 << 22):
        got = N.room(sketches, n, i, j, 0.8, chunk) >= 0
        assert got.tolist() == [N.may_reach(sketches[a], sketches[b], n[a], n[b], 0.8) for a, b in zip(i, j, strict=True)]
    assert got.any() and not got.all()
