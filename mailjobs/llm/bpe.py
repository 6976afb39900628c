"""Byte-level BPE through a sentencepiece model that is serialised from a rank file.

The rank file (base64 token, rank) is turned into a sentencepiece BPE model without training: every
byte of a token is mapped to one printable character, the piece's score is minus its rank, and the
normaliser is the identity. Sentencepiece merges the adjacent pair with the best score first, the
leftmost of equals, which is the merge order of the ranks. Pre-tokens are encoded one by one; ids are
decoded by the inverse byte map.

Defined results: a null text counts as empty (no ids); an empty text has no ids and decodes to no
bytes; repeated rows give repeated rows; other columns of the input take no part.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import short

#: Distinct pre-tokens that one worker keeps encoded; beyond it the store starts anew.
CACHE = 200_000


def byte_characters() -> list[str]:
    """One printable character for each byte value: printable Latin-1 bytes stand for themselves,
    the others take the code points from 256 on, in byte order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The model file's bytes: piece 0 is the unknown piece, piece k + 1 is the token of rank k."""
    chars = byte_characters()
    # The field numbers and enum values of the public sentencepiece_model.proto.
    piece, score, kind, unknown = 1, 2, 3, 2
    pieces, trainer, normaliser = 1, 2, 3
    model_type, bpe, vocab_size = 3, 2, 4
    name, add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces = 1, 3, 4, 5

    out = [_bytes_field(pieces, _bytes_field(piece, b"<unk>") + _int_field(kind, unknown))]
    for rank, token in enumerate(tokens):
        text = "".join(chars[b] for b in token).encode()
        out.append(_bytes_field(pieces, _bytes_field(piece, text) + _varint(score << 3 | 5) + struct.pack("<f", -float(rank))))
    out.append(_bytes_field(trainer, _int_field(model_type, bpe) + _int_field(vocab_size, len(tokens) + 1)))
    out.append(_bytes_field(normaliser, _bytes_field(name, b"identity") + _int_field(add_dummy_prefix, 0) + _int_field(remove_extra_whitespaces, 0) + _int_field(escape_whitespaces, 0)))
    return b"".join(out)


class Codec:
    """Encodes and decodes whole texts; one for each Python worker."""

    def __init__(self, vocabulary: str, pattern: str, cache: int = CACHE):
        import regex
        import sentencepiece

        self.tokens = read_ranks(vocabulary)
        self.whole = {token: rank for rank, token in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.split = regex.compile(pattern).findall
        self.chars = byte_characters()
        self.map = {k: c for k, c in enumerate(self.chars)}
        self.known: dict[str, bytes] = {}
        self.cache = cache

    def _learn(self, pretokens: list[str]) -> dict[str, bytes]:
        """Ids, as little-endian bytes, of pre-tokens that are not known yet."""
        raw = [p.encode() for p in pretokens]
        ids = self.model.encode([b.decode("latin-1").translate(self.map) for b in raw], num_threads=1)
        out = {}
        for pretoken, data, found in zip(pretokens, raw, ids, strict=True):
            rank = self.whole.get(data)
            out[pretoken] = struct.pack("<I", rank) if rank is not None else struct.pack(f"<{len(found)}I", *(k - 1 for k in found))
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pretokens = self.split(text or "")
        if new := [p for p in dict.fromkeys(pretokens) if p not in self.known]:
            if len(self.known) + len(new) > self.cache:
                self.known = {}
                new = list(dict.fromkeys(pretokens))
            self.known.update(self._learn(new))
        return b"".join(map(self.known.__getitem__, pretokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def _outputs(digests: bool) -> list[T.StructField]:
    if digests:
        return [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, digests: bool = False, cache: int = CACHE) -> DataFrame:
    """Encodes every whole ``text`` and decodes the ids again: one narrow stage, no shuffle.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (bytes); with
    ``digests`` the SHA-256 of both instead, so that large results needn't leave the worker.
    ``vocabulary`` is the path of the rank file, the same on every machine.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *_outputs(digests)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary, pattern, cache)
        kind = pa.string() if digests else pa.binary()
        for batch in short(batches):
            n, ids_out, text_out = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                decoded = codec.decode(ids)
                n.append(len(ids) // 4)
                ids_out.append(hashlib.sha256(ids).hexdigest() if digests else ids)
                text_out.append(hashlib.sha256(decoded).hexdigest() if digests else decoded)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_out, kind), pa.array(text_out, kind)], names=[f.name for f in schema])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
