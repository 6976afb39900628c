import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mailjobs.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+").findall


def fill(sizes, weights=(1.0, 2.0, 3.0), epochs=3):
    """Targets by repeated sharing, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, rest = {}, set(sizes), float(sum(sizes.values()))
    while free:
        level = rest / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > epochs * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in free}
        for s in full:
            target[s] = float(epochs * sizes[s])
            rest -= target[s]
        free -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 1, "d": 5, None: 7}, {"a": 1, "b": 2, "c": 10_000, "d": 3, "e": 3}, {"x": 5}, {"a": 0, "b": 5}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in M.source_targets(rows).collect()}
    for s, t in fill(sizes).items():
        assert got[s] == pytest.approx(t)


def test_taken_meets_targets_and_reruns_agree(docs):
    rows = M.curriculum(docs).collect()
    by = defaultdict(lambda: [0, 0.0])
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and all(0 <= c["position"] <= 1 for c in r["copies"])
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    assert all(abs(taken - target) <= 1 for taken, target in by.values())
    again = M.curriculum(docs.repartition(13)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


@pytest.mark.parametrize("knots", [((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.4, 2.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0))])
def test_demand_time_inverts_the_integral(spark, knots):
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))

    def integral(t):
        out = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            x = min(max(t - t0, 0.0), t1 - t0)
            out += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        return out / area

    rows = spark.range(101).select((F.col("id") / 100).alias("u"), M.demand_time(F.col("id") / 100, F.lit(0), (knots,)).alias("t")).collect()
    assert all(integral(r["t"]) == pytest.approx(r["u"], abs=1e-9) for r in rows)


def test_early_sources_come_early(docs):
    order = M.curriculum(docs).select("source", F.explode("copies").alias("c")).groupBy("source").agg(F.avg("c.position").alias("p"))
    p = {r["source"]: r["p"] for r in order.collect()}
    falling, rising = [p[s] for i, s in enumerate(sorted(p)) if i % 3 == 0], [p[s] for i, s in enumerate(sorted(p)) if i % 3 == 2]
    assert sum(falling) / len(falling) < sum(rising) / len(rising)


def test_training_order_is_sorted(docs):
    positions = [r["position"] for r in M.training_order(M.curriculum(docs)).collect()]
    assert positions == sorted(positions)


def test_odd_rows(odd, empty):
    got = M.curriculum(odd).collect()
    assert len(got) == odd.count()
    assert all(r["taken"] == 0 and r["copies"] == [] for r in got if r["size"] == 0)
    assert M.curriculum(empty).count() == 0 and M.materialise(empty).count() == 0
    out = M.materialise(odd)
    assert out.columns == odd.columns
    words = sum(len(WORD(r["text"])) for r in out.collect())
    assert abs(words - sum(r["size"] for r in got)) <= 40


def test_materialised_words_equal_taken(docs):
    taken = M.curriculum(docs).agg(F.sum("taken")).first()[0]
    assert sum(len(WORD(r["text"])) for r in M.materialise(docs).collect()) == taken


def test_repeated_and_null_rows(spark):
    """Rows that agree in all columns have all their copies; null ids are spread over buckets."""
    rows = [(1, "a b c", "s", 5)] * 4 + [(None, f"w{k} x", "s", 4) for k in range(400)] + [(2, "one", None, 3), (3, "", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    taken = M.curriculum(docs).agg(F.sum("taken")).first()[0]
    out = [tuple(r) for r in M.materialise(docs).collect()]
    assert sum(len(WORD(r[1])) for r in out) == taken
    assert sorted(out, key=str) == sorted((tuple(r) for r in M.materialise(docs.repartition(7)).collect()), key=str)
    order = M.sized(docs).where("doc_id is null").select("order").distinct().count()
    assert order == 400


def test_documents_are_range_sorted(docs):
    first = [r["copies"][0]["position"] if r["copies"] else 2.0 for r in M.by_position(M.curriculum(docs)).collect()]
    assert first == sorted(first)
