import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailjobs.llm import bpe
from mailjobs.llm.queries import BPE_FILE, bpe_pattern, vocabulary


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(vocabulary(BPE_FILE), bpe_pattern(), cache=100)


@pytest.fixture(scope="module")
def peer():
    import tiktoken

    with open(vocabulary(BPE_FILE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe_pattern(), mergeable_ranks=ranks, special_tokens={})


def ids(codec, text):
    return np.frombuffer(codec.encode(text), dtype="<u4").tolist()


TEXTS = ["", " ", "Hello  world\n\n x", "ñandú größe 日本語 😀😀", "it's we'll 'd", "\t\t\r\n    ", "<|endoftext|>", "a" * 3000, "x1y22z333 " * 50, "\x00\x01▁Ġ", "é ﬁ Å", "0000000000000000"]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_tiktoken(codec, peer, text):
    assert ids(codec, text) == peer.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(codec, peer, text):
    assert ids(codec, text) == peer.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_every_token_is_reached(codec):
    for k in range(0, len(codec.tokens), 97):
        try:
            text = codec.tokens[k].decode()
        except UnicodeDecodeError:
            continue
        assert codec.decode(codec.encode(text)) == codec.tokens[k]


def test_characters_map_one_to_one():
    assert len(set(bpe.byte_characters())) == 256


def test_odd_rows(odd, empty, peer):
    got = bpe.encode_documents(odd, vocabulary(BPE_FILE), bpe_pattern()).collect()
    texts = sorted((r["text"] or "") for r in odd.collect())
    assert sorted(bytes(r["decoded"]).decode() for r in got) == texts
    assert sorted(r["n_tokens"] for r in got) == sorted(len(peer.encode_ordinary(t)) for t in texts)
    assert bpe.encode_documents(empty, vocabulary(BPE_FILE), bpe_pattern(), digests=True).count() == 0
