"""Search and classification in blocks against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailjobs.operators import vectors as V


def plain_search(emb, queries, limit, low):
    out = {}
    for query, user, q in queries:
        scored = []
        for owner, email, index, text, v in emb:
            if owner == user and v is not None and q is not None and any(v) and any(q):
                s = float(np.dot(v, q) / (np.linalg.norm(v) * np.linalg.norm(q)))
                if s >= low:
                    scored.append((-round(s, 9), email, index, text))
        best = {}
        for s, email, _, text in sorted(scored, key=lambda x: x[:3])[: 3 * limit]:
            if text is not None:
                best.setdefault(email, []).append((-s, text))
        ranked = sorted(best.items(), key=lambda x: (-x[1][0][0], x[0]))[:limit]
        out[query] = [(email, [t for _, t in chunks]) for email, chunks in ranked]
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("cells", [1 << 22, 64 * 5])
def test_search(spark, cells):
    rng = np.random.default_rng(0)
    same = rng.normal(size=5).tolist()
    emb = [(int(rng.choice([0, 0, 0, 1, 2])), f"e{k // 3}", k % 3, None if k % 17 == 0 else f"t{k}", same if k % 9 == 0 else rng.normal(size=5).tolist()) for k in range(600)]
    emb += [(0, "zero", 0, "z", [0.0] * 5), (0, "none", 0, "n", None)]
    queries = [(k, k % 4, rng.normal(size=5).tolist()) for k in range(30)] + [(30, 0, [0.0] * 5), (31, 1, None), (32, 0, same)]
    e = spark.createDataFrame(emb, "user_id int, email_id string, chunk_index int, chunk_text string, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id int, user_id int, embedding array<double>")
    got = {}
    for r in V.search_embeddings(e, q, 4, 0.2, cells).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append((r["email_id"], [c["text"] for c in r["chunks"]]))
    assert got == plain_search(emb, queries, 4, 0.2)
    assert V.search_embeddings(e.where("false"), q, 4, 0.2).count() == 0 == V.search_embeddings(e, q.where("false"), 4, 0.2).count()


def test_no_row_holds_two_vectors(spark):
    e = spark.createDataFrame([(0, "e", 0, "t", [1.0])], "user_id int, email_id string, chunk_index int, chunk_text string, embedding array<double>")
    q = spark.createDataFrame([(1, 0, [1.0])], "query_id int, user_id int, embedding array<double>")
    plan = V.search_embeddings(e, q)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("k0" in line for line in joins)  # with the sizes of the users' blocks only
    assert "MapInArrow" in plan


def test_many_centroids(spark):
    rng = np.random.default_rng(1)
    c, x = rng.normal(size=(20_000, 6)), rng.normal(size=(300, 6))
    x[:40] = c[:40]
    unit = c / np.linalg.norm(c, axis=1, keepdims=True)
    score = x / np.linalg.norm(x, axis=1, keepdims=True) @ unit.T
    centroids = spark.createDataFrame([(f"c{k:05d}", v) for k, v in enumerate(c.tolist())], "label string, embedding array<double>").repartition(7)
    rows = spark.createDataFrame([(k, v, "old") for k, v in enumerate(x.tolist())], "id int, embedding array<double>, label string")
    two = np.sort(score, axis=1)[:, -2:]
    want = {k: (f"c{score[k].argmax():05d}" if two[k, 1] >= 0.3 and two[k, 1] - two[k, 0] >= 1e-4 else "uncategorized", round(float(two[k, 1]), 9)) for k in range(300)}
    got = {r["id"]: (r["label"], round(r["score"], 9)) for r in V.classify_by_centroid(rows, centroids, margin=1e-4).collect()}
    assert got == want and len({v[0] for v in want.values()}) > 20


@pytest.mark.parametrize("n", [1, 2, 9])
def test_blocks_of_centroids_agree_with_a_broadcast(spark, n):
    rng = np.random.default_rng(n)
    centroids = spark.createDataFrame([(f"c{k}", v) for k, v in enumerate([*rng.normal(size=(n, 3)).tolist(), [1.0, 2.0, 3.0]][:n])], "label string, embedding array<double>")
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([*rng.normal(size=(50, 3)).tolist(), [0.0, 0.0, 0.0], [1.0, 2.0, 3.0]])], "id int, embedding array<double>")
    plain = lambda d: sorted((r["id"], r["label"], round(r["score"], 12)) for r in d.collect())
    assert plain(V.classify_by_centroid(rows, centroids)) == plain(V.classify_in_blocks(rows, centroids, cells=64 * 3))
    assert V.classify_in_blocks(rows.where("false"), centroids).count() == 0
    with pytest.raises(ValueError):
        V.classify_by_centroid(rows, centroids.where("false"))


def test_other_columns_stay(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "k0", None)], "id int, embedding array<double>, k0 string, part string")
    got = V.classify_in_blocks(rows, spark.createDataFrame([("a", [1.0, 0.1])], "label string, embedding array<double>")).first()
    assert (got["id"], got["k0"], got["part"], got["label"]) == (1, "k0", None, "a")
    assert rows.join(F.broadcast(rows.select("id")), "id").count() == 1
