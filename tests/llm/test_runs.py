import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailjobs.llm import runs
from mailjobs.llm.queries import looped, queries


def brute(words):
    """All runs by trying every period at every place."""
    n, out, seen = len(words), [], []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= max(6, 4 * q) and not any(s <= start and end <= e and q % r == 0 for s, e, r in seen):
                out.append((start, end - start, q))
                seen.append((start, end, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_a_multiple_of_the_period_found_first():
    words = list("baaaaa" * 9 + "abaa" * 4)
    assert runs.word_runs(words) == brute(words) and (0, 54, 6) in brute(words)


def kept(words, found):
    return " ".join(w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in found))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab", max_size=70))
def test_two_words(text):
    assert runs.word_runs(list(text)) == brute(list(text))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abcde", min_size=1, max_size=9), st.integers(1, 9)), max_size=7))
def test_powers(parts):
    words = list("".join(x * n for x, n in parts))
    found = runs.word_runs(words)
    assert found == brute(words)
    assert runs.collapsed(words, found) == kept(words, found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab", min_size=1, max_size=4), st.integers(1, 8)), min_size=1, max_size=4), st.integers(1, 7), st.text(alphabet="abc", max_size=9))
def test_powers_of_powers(parts, n, tail):
    words = list("".join(x * k for x, k in parts) * n + tail)
    assert runs.word_runs(words) == brute(words)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=60))
def test_the_grammar_gives_the_runs_without_the_candidates(text):
    words = list(text)
    ids = runs.np.array([ord(c) for c in words], dtype="int64")
    assert sorted(runs.grammar_runs(ids), key=lambda r: (r[0], r[2])) == brute(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=200))
def test_the_grammar_derives_the_sequence(ids):
    g = runs.Grammar(ids)

    def derived(symbol):
        return [symbol] if symbol < g.terminals else [x for s in g.pairs[symbol - g.terminals] for x in derived(s)]

    assert derived(g.top) == ids
    assert [g.size[s] for s in range(len(g.size))] == [len(derived(s)) for s in range(len(g.size))]


@pytest.mark.parametrize("period", [1, 5, 37, 400])
def test_long_runs_in_long_texts(period):
    rng = random.Random(period)
    block = [str(rng.randrange(50)) for _ in range(period)]
    noise = [str(rng.randrange(10**9)) for _ in range(3000)]
    words = noise[:1000] + (block * 40_000)[:20_003] + noise[1000:]
    found = runs.word_runs(words)
    assert any(q <= period and s <= 1000 and s + n >= 21_003 for s, n, q in found)
    assert runs.word_runs(noise) == []


def test_a_text_of_one_word_and_runs_inside_runs():
    assert runs.word_runs(["w"] * 30_000) == [(0, 30_000, 1)]
    inner = ["x"] * 6 + ["y", "z"]
    found = runs.word_runs(inner * 50)
    assert (0, 400, 8) in found and sum(r[2] == 1 for r in found) == 50


def expected(rows):
    out = set()
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.add((doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept(words, found))))
    return out


def test_query_equals_brute_force(spark, sf, docs):
    got = {tuple(r) for r in queries()["op13_periodic_runs"](spark, sf).collect()}
    short = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 6000]
    want = expected(short)
    assert len(want) > 150 and sum(r[1] > 0 for r in want) > 10
    assert want <= got and len(got) == docs.count()


def test_odd_rows(odd, empty):
    got = runs.find(odd)
    by_text = {(r["doc_id"], r["n_words"]): [tuple(x) for x in r["runs"]] for r in got.collect()}
    assert len(by_text) == odd.select("doc_id").distinct().count() and got.count() == odd.count()
    assert by_text[7, 30_000] == [(0, 30_000, 1)] and by_text[3, 0] == [] and by_text[4, 0] == []
    assert runs.find(empty).count() == 0 and looped(odd).count() == odd.count() and looped(empty).count() == 0
