import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailjobs.llm import hardnegatives as H
from mailjobs.llm import oracles, queries
from tests.helpers import same

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every, positives=5, negatives=5, scale=1):
    good = {(i, label, tuple(int(np.floor(scale * x)) for x in v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    hold = lambda x: max(-(2**63), min(2**63 - 1, x))
    out = set()
    for a, label, v in good:
        if a % every:
            continue
        scored = sorted((-hold(sum(x * y for x, y in zip(v, w, strict=True))), i, m) for i, m, w in good if len(w) == len(v))
        for s, p in [(s, i) for s, i, m in scored if m == label and i != a][:positives]:
            below = [(t, i) for t, i, m in scored if m != label and 80 * -s <= 100 * -t <= 100 * -s][:negatives]
            out |= {(a, p, r, i, -s, -t) for r, (t, i) in enumerate(below, 1)}
    return out


def mined(spark, rows, every, **options):
    got = [tuple(r) for r in H.mine(spark.createDataFrame(rows, SCHEMA), every, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", [0, 1])
def test_random_vectors(spark, seed):
    rng = np.random.default_rng(seed)
    spread = rng.lognormal(0, 1.5, size=400) if seed else np.ones(400)
    rows = [(i, (spread[i] * 20 * (rng.normal(size=6) + seed)).tolist(), int(rng.integers(3))) for i in range(400)]
    assert mined(spark, rows, 10, scale=1) == brute(rows, 10) != set()


def test_copies_ties_and_rows_that_take_no_part(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [3.0, 4.0, 0.0], i % 2) for i in range(150)] + [(i, rng.integers(-3, 6, 3).astype(float).tolist(), int(rng.integers(3))) for i in range(150, 300)]
    rows += [(20, [3.0, 4.0, 0.0], 0), (30, [5.0, 4.0, 1.0], 2), (30, [5.0, 4.0, 1.0], 2), (310, [0.0] * 3, 1), (320, [-9.0] * 3, 1), (-10, [2.0, 2.0, 2.0], 0)]
    rows += [(330, [4.0, 4.0], 0), (331, [4.0, 3.0], 0), (332, [4.0, 3.0], 1), (340, [], 0), (341, [], 0), (342, [], 1)]
    odd = [(400, None, 0), (410, [float("nan")] * 3, 0), (420, [None, 1.0, 1.0], 1), (430, [float("inf"), 0.0, 0.0], 1), (440, [9.0, 9.0, 9.0], None), (None, [9.0, 9.0, 9.0], 1)]
    monkeypatch.setattr(H, "LEAST_ROWS", 40)
    assert mined(spark, rows + odd, 10, scale=1) == brute(rows, 10)


def test_scores_beyond_a_float_stay_exact(spark):
    rows = [(0, [2.0**40, 3.0], 0), (1, [2.0**22, 1.0], 0), (2, [2.0**22, 0.0], 1), (3, [2.0**22, -1.0], 1), (10, [2.0**50, 1.0], 0), (11, [2.0**40, 7.0], 1), (20, [1e300, 0.0], 1)]
    assert mined(spark, rows, 10, scale=1) == brute([(i, [min(x, 2.0**63 - 1024) if x > 2.0**63 else x for x in v], m) for i, v, m in rows if i != 20], 10) | {r for r in mined(spark, rows, 10, scale=1) if 20 in (r[0], r[1], r[3])}


def test_few_rows(spark):
    assert mined(spark, [], 10) == set()
    assert mined(spark, [(0, [1.0], 0)], 10) == set()
    assert mined(spark, [(0, [1.0], 0), (1, [1.0], 0)], 10) == set()
    assert mined(spark, [(0, [1.0], 0), (1, [1.0], 0), (2, [0.9], 1)], 10) == {(0, 1, 1, 2, 65536, 58880)}


@settings(max_examples=120, deadline=None)
@given(st.data())
def test_units_find_what_a_full_scan_finds(data):
    n, dim = data.draw(st.integers(1, 60)), data.draw(st.integers(0, 7))
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    vectors = np.round(rng.normal(size=(n, dim)) * rng.lognormal(2, 1, size=(n, 1)) + data.draw(st.integers(-9, 9))).astype(np.int64)
    labels, first = rng.integers(0, 2, n), rng.permutation(n)
    anchor = vectors[0]
    scores = vectors @ anchor
    windows = [(int(a), int(a) + int(b)) for a, b in zip(rng.choice(scores, 3), rng.integers(0, 900, 3), strict=True)] + [(-H.LONG - 1, H.LONG)]
    apart, k = data.draw(st.sampled_from([None, 0, 1])), data.draw(st.integers(1, 6))
    found = H.Unit(vectors, first, labels).search(anchor, windows, k, apart)
    for (low, high), (score, at) in zip(windows, found, strict=True):
        good = [x for x in range(n) if low <= scores[x] <= high and labels[x] != apart]
        want = sorted(good, key=lambda x: (-scores[x], first[x]))[:k]
        assert at.tolist() == want and score.tolist() == scores[want].tolist()


def test_ranges_rule_out_most_rows():
    rng = np.random.default_rng(4)
    vectors = np.round(256 * rng.normal(size=(5000, 16)) / 4).astype(np.int64)
    vectors[:20] = np.round(vectors[0] * rng.uniform(0.9, 1.1, size=(20, 16)))
    unit = H.Unit(vectors, np.arange(5000), np.zeros(5000, dtype=np.int64))
    scored = []
    plain = unit.scores
    unit.scores = lambda bucket, rows, anchor: scored.append(len(bucket.at) if rows is None else len(rows)) or plain(bucket, rows, anchor)
    low = int(np.sort(vectors @ vectors[0])[-20])
    (found,) = unit.search(vectors[0], [(low, H.LONG)], 20, None)
    assert len(found[0]) == 20 and sum(scored) < 1500


def test_clashing_names_and_an_empty_table(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, [float(i % 7), 1.0], i % 2) for i in range(40)], SCHEMA)
    names = ("h1", "h2", "v", "dim", "part", "kind", "ids", "g", "score", "scores", "rank")
    clash = rows.withColumns({c: F.lit("clash") for c in names})
    assert sorted(map(tuple, H.mine(clash, 10).collect())) == sorted(map(tuple, H.mine(rows, 10).collect())) != []
    assert H.mine(clash.where("false")).count() == 0


def test_query_equals_sql_on_more_rows(spark):
    sf = "/root/testdata/sf0.1"
    same(queries.queries()["op12_hard_negatives"](spark, sf), oracles.oracle_sql()["op12_hard_negatives"], sf)
