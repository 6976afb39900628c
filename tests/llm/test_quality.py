from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailjobs.llm import quality as Q


def plain(words, size=5):
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(size)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeat_words(words):
    assert Q.repeat_words(words) == plain(words)


def test_repeat_words_with_many_distinct_words():
    words = [str(i) for i in range(9000)] + [str(i) for i in range(100, 110)]
    assert Q.repeat_words(words) == plain(words) == 20


def test_measure():
    m = dict(zip(Q.MEASURES, Q.measure("a b c #1\na b c #1\n\n  \nX! <y>"), strict=True))
    assert m == {"n_words": 10, "word_chars": 15, "n_symbols": 4, "n_dup_lines": 1, "n_repeat_words": 0, "n_lines": 3, "n_upper_words": 1, "n_exclaim": 1}


def test_policies_and_ablations_equal_a_plain_count(docs):
    rows = Q.ledger(docs).collect()
    names = [n for n, _ in Q.RULES]
    for r in Q.ablations(Q.ledger(docs)).collect():
        mask, bit = Q.mask(Q.POLICIES[r["policy"]]), 1 << names.index(r["rule"])
        assert r["n_failed"] == sum(bool(x["fail_bits"] & bit) for x in rows)
        assert r["n_only_this"] == sum(x["fail_bits"] & mask == bit for x in rows)
        assert r["n_rejected"] == sum(bool(x["fail_bits"] & mask) for x in rows)


def test_good_documents_stay(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = Q.apply_policy(Q.ledger(docs), Q.POLICIES["v2"]).join(labels, "doc_id").where("n_words >= 10").collect()
    good = [r["kept"] for r in kept if r["quality"] == 1]
    assert sum(good) / len(good) > 0.95


@pytest.mark.parametrize("make", [Q.ledger, Q.annotate])
def test_odd_rows(odd, empty, make):
    got = make(odd).collect()
    assert len(got) == odd.count()
    assert all(r["fail_bits"] & 1 for r in got if r["doc_id"] in (3, 4, 5))
    assert make(empty).count() == 0


def test_annotate_equals_ledger(odd):
    key = lambda d: sorted(((r["doc_id"] or 0), r["fail_bits"]) for r in d.select("doc_id", "fail_bits").collect())
    annotated = Q.annotate(odd.drop("fail_bits"))
    assert key(annotated) == key(Q.ledger(odd)) and annotated.columns == [*odd.drop("fail_bits").columns, "fail_bits"]
