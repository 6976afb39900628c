import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailjobs.llm import langid as L
from mailjobs.llm.queries import PIECES_FILE, vocabulary


@pytest.fixture(scope="module")
def segmenter():
    pieces = L.read_pieces(vocabulary(PIECES_FILE))
    weights = np.random.default_rng(1).random((max(pieces.values()) + 1, 3))
    return L.Segmenter(pieces, weights / weights.sum(axis=0))


def by_hand(s, word):
    """Sum over all segmentations, by recursion."""
    memo = {len(word): np.ones(s.size)}
    arcs = s.arcs(word)
    for i in range(len(word) - 1, -1, -1):
        memo[i] = sum((memo[j] * s._weight(ids) for a, j, ids in arcs if a == i), np.zeros(s.size))
    return np.log(memo[0])


@pytest.mark.parametrize("word", ["the", "thinghened", "größe", "ñandú", "日本", "Ωmega", "a", "internationalisation"])
def test_forward_equals_enumeration(segmenter, word):
    want = by_hand(segmenter, L.MARK + word)
    assert np.allclose(segmenter.scores([L.MARK + word])[0], want)
    assert np.allclose(segmenter.long(L.MARK + word), want)


def test_words_of_one_batch_do_not_mix(segmenter):
    words = [L.MARK + w for w in ("the", "of", "größe", "x" * 60, "日本")]
    assert np.allclose(segmenter.scores(words), np.vstack([segmenter.scores([w]) for w in words]))


def test_long_words_stay_finite(segmenter):
    assert np.isfinite(segmenter.long(L.MARK + "ab" * 20_000)).all()


def test_expected_counts_of_a_word_sum_to_its_letters(segmenter):
    into = {}
    segmenter.expected(L.MARK + "thing", 0, 2.0, into)
    back = {k: p for p, k in segmenter.pieces.items()}
    assert math.isclose(sum(v * len(back[k]) for k, v in into.items()), 2.0 * 6)


def test_expected_counts_equal_enumeration(segmenter):
    """Over all segmentations of a short word, each weighed by its probability."""
    word, want, total = L.MARK + "the", {}, 0.0
    arcs = segmenter.arcs(word)

    def walk(i, ids, p):
        nonlocal total
        if i == len(word):
            total += p
            for k in ids:
                want[k] = want.get(k, 0.0) + p
            return
        for a, j, more in arcs:
            if a == i:
                walk(j, ids + more, p * math.prod(segmenter.weights[k, 1] for k in more))

    walk(0, (), 1.0)
    got = {}
    segmenter.expected(word, 1, 3.0, got)
    assert got == pytest.approx({k: 3.0 * v / total for k, v in want.items()})


def test_long_words_are_learned_from(spark):
    long = "zq" * 500
    docs = spark.createDataFrame([("a", long)] * 3 + [("b", "the of and")], "lang string, text string")
    path = vocabulary(PIECES_FILE)
    model = L.train(docs, path, rounds=1)
    pieces = L.read_pieces(path)
    assert model["a"][pieces["z"]] > 100 * model["b"][pieces["z"]]
    assert L.identify(spark.createDataFrame([(1, long + " " + long)], "doc_id long, text string"), model, path).first()["lang_pred"] == "a"


def test_query_equals_brute_force(spark, tmp_path):
    """The registered query on a small table, against plain expectation-maximisation and plain sums."""
    from mailjobs.llm import queries

    rows = [(k, t, lang, "s", len(t)) for k, (t, lang) in enumerate([("the thing of the day", "en"), ("and the other thing", "en"), ("der Tag und die Nacht", "de"), ("die Stadt und der Wald", "de"), ("the nights", "en"), ("der Wald", "de"), ("Ärger größer", "de"), ("123", None), ("thing und the", None), ("othering ΩΩ", "en")])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, str(tmp_path)).collect()}

    import zlib
    from collections import Counter

    held = {k: zlib.crc32(str(k).encode()) % 5 == 0 for k, *_ in rows}
    pieces = L.read_pieces(vocabulary(PIECES_FILE))
    counts = {"de": Counter(), "en": Counter()}
    for k, text, lang, *_ in rows:
        if lang and not held[k]:
            counts[lang].update(L.words_of(text))
    size = max(pieces.values()) + 1
    weights = np.zeros((size, 2))
    weights[sorted(pieces.values())] = 1 / len(pieces)
    for _ in range(4):
        s = L.Segmenter(pieces, weights)
        new = np.zeros((size, 2))
        new[sorted(pieces.values())] = 0.05
        for m, lang in enumerate(("de", "en")):
            for word, n in counts[lang].items():
                arcs = s.arcs(L.MARK + word)
                paths = [((), 0, 1.0)]
                whole = []
                while paths:
                    ids, at, p = paths.pop()
                    if at == len(word) + 1:
                        whole.append((ids, p))
                    paths += [(ids + more, j, p * float(np.prod(weights[list(more), m]))) for i, j, more in arcs if i == at]
                total = sum(p for _, p in whole)
                for ids, p in whole:
                    for k in ids:
                        new[k, m] += n * p / total
        weights = new / new.sum(axis=0)
    s = L.Segmenter(pieces, weights)
    for k, text, *_ in rows:
        words = L.words_of(text)
        assert got[k]["held_out"] == held[k]
        if not words:
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
            continue
        log = sum(by_hand(s, L.MARK + w) for w in words)
        best = int(np.argmax(log))
        assert got[k]["lang_pred"] == ("de", "en")[best]
        assert got[k]["score"] == pytest.approx(float(1 / np.exp(log - log[best]).sum()))


def test_words():
    assert L.words_of("L'été, 3½ x²y Dog") == ["l", "été", "x", "y", "dog"]
    assert L.words_of(None) == [] and L.words_of("12 !") == []


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    path = vocabulary(PIECES_FILE)
    model = L.train(docs.where(~L.held_out(F.col("doc_id"))), path, max_docs=100, rounds=2)
    found = L.identify(docs, model, path).join(docs.select("doc_id", "lang"), "doc_id").where(L.held_out(F.col("doc_id")))
    good = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert good > 0.97


def test_odd_rows(spark, odd, empty):
    path = vocabulary(PIECES_FILE)
    model = L.train(odd, path, rounds=1)
    got = L.identify(odd, model, path).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5, 6)} == {"und"}
    assert L.train(empty, path) == {}
    assert {r["lang_pred"] for r in L.identify(odd, {}, path).collect()} == {"und"}
    assert L.identify(empty, model, path).count() == 0
