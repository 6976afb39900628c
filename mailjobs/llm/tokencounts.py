"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch that aren't known yet lie behind one another in one array of symbols, with an
array that names each symbol's sequence. A round finds the lowest rank among the pairs of each sequence,
merges all places of that pair in all sequences at once, and drops the sequences that are done. A merge's
product takes part in later merges only, so merging all places of the lowest pair together is the same as
merging them one after another. Only the number of symbols that survive is kept.

Sequences are cut beforehand between bytes that stand beside each other in no token: nothing merges
across, and long pre-tokens become short. Long texts are split into pre-tokens piece by piece, so that a
worker's memory is bounded by the text and a piece's pre-tokens.

Defined results: a null text counts as empty: no bytes, no tokens; repeated rows give repeated rows; an
empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_characters
from .common import short

#: Distinct pre-tokens whose counts one worker keeps; beyond it the store starts anew.
CACHE = 200_000
#: Characters of text that are split into pre-tokens at a time.
PIECE = 1 << 20
#: The rank of pairs that aren't merged.
NEVER = np.iinfo(np.int64).max


class Merges:
    """The merge table of a byte-level BPE, as arrays."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        chars = byte_characters()
        self.size = max(vocabulary.values(), default=0) + 1
        self.of_byte = np.array([vocabulary[c] for c in chars], dtype=np.int64)
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in merges], dtype=np.int64)
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.product = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        back = {c: k for k, c in enumerate(chars)}
        self.meet = np.zeros((256, 256), dtype=bool)
        for token in vocabulary:
            if all(c in back for c in token):
                codes = [back[c] for c in token]
                self.meet[codes[:-1], codes[1:]] = True

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, NEVER where no merge joins them."""
        if not len(self.keys):
            return np.full(len(left), NEVER)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NEVER)

    def survivors(self, pretokens: list[bytes]) -> np.ndarray:
        """How many symbols are left of each pre-token once no pair merges."""
        sizes = np.fromiter(map(len, pretokens), dtype=np.int64, count=len(pretokens))
        flat = np.frombuffer(b"".join(pretokens), dtype=np.uint8)
        owner = np.repeat(np.arange(len(pretokens)), sizes)
        count = sizes.copy()
        if len(flat) < 2:
            return count
        within = (owner[1:] == owner[:-1]) & self.meet[flat[:-1], flat[1:]]
        sequence = np.cumsum(np.append(0, ~within))
        symbol = self.of_byte[flat]
        rank = np.append(np.where(within, self.ranks(symbol[:-1], symbol[1:]), NEVER), NEVER)
        while True:
            starts = np.flatnonzero(np.append(True, sequence[1:] != sequence[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            lowest = np.repeat(lowest, np.diff(np.append(starts, len(sequence))))
            going = lowest < NEVER
            if not going.any():
                return count
            symbol, sequence, owner, rank, lowest = (x[going] for x in (symbol, sequence, owner, rank, lowest))
            at = np.flatnonzero(rank == lowest)
            # Places of a pair of equal symbols overlap in a run of them: every second one is merged.
            begins = np.append(True, np.diff(at) != 1)
            first = np.repeat(at[begins], np.diff(np.append(np.flatnonzero(begins), len(at))))
            at = at[(at - first) % 2 == 0]
            np.subtract.at(count, owner[at], 1)
            symbol[at] = self.product[rank[at]]
            left = np.ones(len(symbol), dtype=bool)
            left[at + 1] = False
            # A merged symbol and the one before it have new neighbours.
            stale = np.zeros(len(symbol), dtype=bool)
            stale[at] = True
            symbol, sequence, owner, rank, stale = (x[left] for x in (symbol, sequence, owner, rank, stale))
            stale[:-1] |= stale[1:]
            again = np.flatnonzero(stale)
            last = np.append(sequence[1:] != sequence[:-1], True)[again]
            rank[again[last]] = NEVER
            again = again[~last]
            rank[again] = self.ranks(symbol[again], symbol[again + 1])


def unassigned(letters: str, tokenizer) -> str:
    """Characters that the pattern's engine takes for letters or numbers (``letters``) by a newer Unicode
    than the tokenizer's own pre-tokenizer, which sets them off from a letter before them."""
    return "".join(c for c in letters if len(tokenizer.pre_tokenizer.pre_tokenize_str("a" + c)) > 1 and len(tokenizer.pre_tokenizer.pre_tokenize_str("1" + c)) > 1)


def ranges(letters: str) -> str:
    """Ascending characters as the ranges of a character class."""
    codes = np.array([ord(c) for c in letters])
    ends = np.flatnonzero(np.diff(codes) != 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[np.append(0, ends + 1)], codes[np.append(ends, len(codes) - 1)], strict=True))


class Counter:
    """Counts tokens as the tokenizers library does with the same file; one for each Python worker."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE, piece: int = PIECE):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        before, model = file["pre_tokenizer"] or {}, file["model"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "unk_token"))
        if file["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or not plain:
            raise ValueError("not a plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
            raise ValueError("added tokens that take neighbours with them aren't supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges)
        added = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.split, self.careful, self.newer = regex.compile(pattern), *self._older(path, pattern)
        self.known: dict[str, int] = {}
        self.cache, self.piece = cache, piece

    @staticmethod
    def _older(path: str, pattern: str):
        """The pattern for texts with characters that only a newer Unicode knows, and what finds these."""
        import unicodedata

        import regex
        from tokenizers import Tokenizer

        candidates = regex.compile(r"[\p{L}\p{N}]").findall("".join(c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn"))
        newer = unassigned("".join(candidates), Tokenizer.from_file(path))
        if not newer:
            return regex.compile(pattern), None
        one = f"[{ranges(newer)}]"
        older = pattern.replace(r"[^\s\p{L}\p{N}]", f"(?:{one}|[^\\s\\p{{L}}\\p{{N}}])")
        for kind in (r"\p{L}+", r"\p{N}+"):
            older = older.replace(f" ?{kind}", f" ?(?:(?!{one}){kind[:-1]})+")
        return regex.compile(older), re.compile(one)

    def pretokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens in lists of bounded length. A piece's last one may be cut short, so the next piece
        begins with it."""
        split = self.careful if self.newer and not text.isascii() and self.newer.search(text) else self.split
        at, step = 0, self.piece
        while at + step < len(text):
            found = split.findall(text, at, at + step)[:-1]
            if not found:
                step *= 2
                continue
            yield found
            at, step = at + sum(map(len, found)), self.piece
        yield split.findall(text, at)

    def learn(self, pretokens: list[str]) -> None:
        self.known.update(zip(pretokens, self.merges.survivors([p.encode() for p in pretokens]).tolist(), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; the new pre-tokens of up to a piece's characters are merged together."""
        out, waiting, size = [0] * len(texts), [], 0

        def settle() -> None:
            nonlocal waiting, size
            if new := [p for p in dict.fromkeys(p for _, found in waiting for p in found) if p not in self.known]:
                if len(self.known) + len(new) > self.cache:
                    self.known = {}
                    new = list(dict.fromkeys(p for _, found in waiting for p in found))
                self.learn(new)
            for k, found in waiting:
                out[k] += sum(map(self.known.__getitem__, found))
            waiting, size = [], 0

        for k, text in enumerate(texts):
            parts = [text or ""]
            if self.added:
                parts = self.added.split(text or "")
                out[k] = len(parts) - 1
            for part in parts:
                for found in self.pretokens(part):
                    waiting.append((k, found))
                    size += sum(map(len, found))
                    if size >= self.piece:
                        settle()
        settle()
        return out


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512, cache: int = CACHE) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``) of every whole text: one
    narrow stage, no shuffle. ``path`` is a byte-level BPE's tokenizer file, the same on every machine."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, pattern, cache)
        for batch in short(batches):
            n = counter.count(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=[f.name for f in schema])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select("doc_id", size, "text").mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
