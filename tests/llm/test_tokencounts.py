import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailjobs.llm import tokencounts
from mailjobs.llm.queries import COUNTED_FILE, bpe_pattern, queries, vocabulary


@pytest.fixture(scope="module")
def counter():
    return tokencounts.Counter(vocabulary(COUNTED_FILE), bpe_pattern(), cache=100, piece=50)


@pytest.fixture(scope="module")
def peer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(COUNTED_FILE))
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


TEXTS = ["", " ", "Hello  world\n\n x", "ñandú größe 日本語 😀😀", "it's we'll 'd", "\t\t\r\n    ", "a<|endoftext|><|endoftext|> b", "<|endof<|endoftext|>text|>", "a" * 3001, "x1y22z333 " * 50, "\x00\x01▁Ġ", "é ﬁ Å", "0000000000000000", "  " * 200 + "x", "漢字かな交じり文" * 40, "a࢏b 𖺠1 ՘x ₏"]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(counter, peer, text):
    assert counter.count([text]) == [peer(text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=120), max_size=4))
def test_any_texts(counter, peer, texts):
    assert counter.count(texts) == [peer(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aehinostr lt'1", max_size=300))
def test_words_like_english(counter, peer, text):
    assert counter.count([text]) == [peer(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=12), max_size=8))
def test_merging_equals_one_merge_at_a_time(raw):
    chars = tokencounts.byte_characters()
    merges = [(chars[a], chars[b]) for a, b in ((1, 1), (0, 1), (2, 0))] + [(chars[1] * 2, chars[1] * 2), (chars[0] + chars[1], chars[2]), (chars[1] * 4, chars[1])]
    table = tokencounts.Merges({t: k for k, t in enumerate([*chars, *dict.fromkeys(a + b for a, b in merges)])}, merges)
    raw = [bytes(b % 3 for b in x) for x in raw]

    def one(data):
        symbols = [chars[b] for b in data]
        while True:
            ranked = [(merges.index(p), k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in merges]
            if not ranked:
                return len(symbols)
            _, k = min(ranked)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]

    assert table.survivors(raw).tolist() == [one(x) for x in raw]


def test_every_character_is_split_as_the_library_does(counter):
    from tokenizers import Tokenizer

    before = Tokenizer.from_file(vocabulary(COUNTED_FILE)).pre_tokenizer
    for start in [*range(0, 0xD800, 64), *range(0xE000, 0x110000, 64)]:
        text = "".join(f"a{chr(c)}1{chr(c)}! {chr(c)}\n" for c in range(start, start + 64))
        offsets = np.cumsum([0, *(len(p) for found in counter.pretokens(text) for p in found)])
        assert [o[0] for _, o in before.pre_tokenize_str(text)] == offsets[:-1].tolist()


def test_whole_texts_and_the_cache(spark, docs, peer):
    got = tokencounts.count_tokens(docs, vocabulary(COUNTED_FILE), bpe_pattern(), cache=50).collect()
    want = {(r["doc_id"], len(r["text"].encode()), peer(r["text"])) for r in docs.select("doc_id", "text").collect()}
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)


def test_query_equals_the_library(spark, sf, docs, peer):
    got = queries()["op11_token_counts"](spark, sf).collect()
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {(r["doc_id"], len(r["text"].encode()), peer(r["text"]), peer(r["text"]) > 512) for r in docs.select("doc_id", "text").collect()}


def test_odd_rows(odd, empty, peer):
    got = tokencounts.count_tokens(odd, vocabulary(COUNTED_FILE), bpe_pattern()).collect()
    texts = [r["text"] or "" for r in odd.select("text").collect()]
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == sorted((len(t.encode()), peer(t)) for t in texts)
    assert tokencounts.count_tokens(empty, vocabulary(COUNTED_FILE), bpe_pattern()).count() == 0
