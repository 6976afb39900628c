"""Language identification with segmentation-marginalised unigrams.

The vocabulary is fixed: the pieces of a public sentencepiece model, read from its file and never
trained. What is learned, for each language, is a probability for each piece. The probability of a
word is the sum over all of its segmentations into pieces (a forward algorithm over positions); the
probability of a text is the product over its words. Learning is expectation-maximisation on word
counts: Spark counts words and sums expected piece counts, the driver only holds the table of
(language, piece), which the vocabulary bounds.

A word is a run of letters, lower-cased, with the word-start mark in front. A letter without a piece
of its own is spelled with the vocabulary's byte pieces.

Defined results: a null text or one without a letter is ``und`` with score 0; an empty training set
makes every text ``und``; rows with a null language are not learned from; ties go to the language
first by code point; repeated rows give repeated rows; other columns take no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short

MARK = "▁"
#: Words that a worker keeps scored; beyond it the store starts anew.
CACHE = 400_000
#: Longer words are scored with rescaling, so that no product runs out of the doubles' range.
LONG = 40


def read_pieces(path: str) -> dict[str, int]:
    """Piece -> id, without control pieces; byte pieces keep their form <0xNN>."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(k): k for k in range(model.get_piece_size()) if not model.is_control(k) and not model.is_unknown(k)}


class PieceTable:
    """Ids of pieces by the hash of their letters, in arrays with open addressing."""

    BITS = 18

    def __init__(self, pieces: dict[str, int], width: int):
        base = 0x9E3779B97F4A7C15
        self.powers = np.array([pow(base, k, 1 << 64) for k in range(1, width + 1)], dtype=np.uint64)
        self.keys, self.ids = np.zeros(1 << self.BITS, dtype=np.uint64), np.full(1 << self.BITS, -1, dtype=np.int64)
        for piece, k in pieces.items():
            h = sum((ord(c) + 1) * int(p) for c, p in zip(piece, self.powers, strict=False)) % (1 << 64)
            slot = self._slot(np.array([h], dtype=np.uint64))[0]
            while self.ids[slot] >= 0:
                slot = (slot + 1) % (1 << self.BITS)
            self.keys[slot], self.ids[slot] = h, k

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ hashes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        todo, slot = np.arange(len(hashes)), self._slot(hashes)
        while len(todo):
            ids = self.ids[slot]
            same = (self.keys[slot] == hashes[todo]) & (ids >= 0)
            out[todo[same]] = ids[same]
            on = ~same & (ids >= 0)
            todo, slot = todo[on], (slot[on] + 1) % (1 << self.BITS)
        return out


class Segmenter:
    """Sums over all segmentations of a word, for all languages at once.

    ``weights`` has one row for each piece id and one column for each language.
    """

    def __init__(self, pieces: dict[str, int], weights: np.ndarray):
        self.pieces, self.weights = pieces, weights
        self.width = max(map(len, pieces))
        self.size = weights.shape[1]
        self.none = np.zeros(self.size)
        self.table = PieceTable({p: k for p, k in pieces.items() if p == MARK or p.lstrip(MARK).isalpha()}, self.width)
        self.bytes = {f"{b:02X}": pieces[f"<0x{b:02X}>"] for b in range(256) if f"<0x{b:02X}>" in pieces}

    def arcs(self, word: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """(start, end, piece ids): one id, or the bytes of a letter that has no piece."""
        out = []
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + self.width) + 1):
                if (k := self.pieces.get(word[i:j])) is not None:
                    out.append((i, j, (k,)))
            if word[i] not in self.pieces:
                out.append((i, i + 1, tuple(self.bytes[f"{b:02X}"] for b in word[i].encode("utf-8", "replace"))))
        return out

    def _weight(self, ids: tuple[int, ...]) -> np.ndarray:
        return self.weights[ids[0]] if len(ids) == 1 else np.prod(self.weights[list(ids)], axis=0)

    def long(self, word: str) -> np.ndarray:
        """Log-probability by language; linear in the word's length, rescaled at each position."""
        alpha: dict[int, np.ndarray] = {0: np.ones(self.size)}
        log = np.zeros(self.size)
        ahead: dict[int, np.ndarray] = {}
        arcs: dict[int, list] = {}
        for i, j, ids in self.arcs(word):
            arcs.setdefault(i, []).append((j, ids))
        for i in range(len(word)):
            here = alpha.pop(i, self.none) if i in alpha else ahead.pop(i, self.none)
            scale = np.where(here > 0, here, 1.0)
            log += np.log(scale)
            here = here / scale
            for j in ahead:
                ahead[j] = ahead[j] / scale
            for j, ids in arcs.get(i, ()):
                ahead[j] = ahead.get(j, self.none) + here * self._weight(ids)
        return log + np.log(np.maximum(ahead.get(len(word), np.ones(self.size)), 1e-300))

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word (with its mark) by language.

        The words are one array of letters. Substrings of each length are looked up by hash, all at
        once; then the forward algorithm takes one step for each place in a word and piece length.
        """
        out = np.zeros((len(words), self.size))
        few = [k for k, w in enumerate(words) if len(w) <= LONG]
        for k, word in enumerate(words):
            if len(word) > LONG:
                out[k] = self.long(word)
        if not few:
            return out
        codes = np.frombuffer("".join(words[k] for k in few).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        sizes = np.array([len(words[k]) for k in few], dtype=np.int64)
        # alpha has one row more than letters for each word: row begin + j is the sum over its first j
        begin = np.cumsum(sizes + 1) - sizes - 1
        row = np.arange(len(codes)) + np.repeat(np.arange(len(few)), sizes)  # of the place before a letter
        place = row - np.repeat(begin, sizes)
        left = np.repeat(sizes, sizes) - place
        weights = self.weights
        arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by length: row, piece, cuts by end place
        at, hashes = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64)
        for k in range(1, self.width + 1):
            on = left[at] >= k
            at, hashes = at[on], hashes[on]
            if not len(at):
                break
            hashes = hashes + (codes[at + k - 1] + np.uint64(1)) * self.table.powers[k - 1]
            piece = self.table.find(hashes)
            if k == 1 and (missing := np.flatnonzero(piece < 0)).size:  # letters that are spelled in bytes
                odd, which = np.unique(codes[at[missing]], return_inverse=True)
                piece[missing] = len(weights) + which
                rows = [self._weight(tuple(self.bytes[f"{b:02X}"] for b in chr(c).encode("utf-8", "replace"))) for c in odd.tolist()]
                weights = np.vstack([weights, *rows])
            hit = np.flatnonzero(piece >= 0)
            ends = (place[at[hit]] + k).astype(np.int8)
            order = np.argsort(ends, kind="stable")
            hit = hit[order]
            arcs.append((row[at[hit]], piece[hit], np.searchsorted(ends[order], np.arange(LONG + 2))))
        alpha = np.zeros((len(codes) + len(few), self.size))
        alpha[begin] = 1.0
        for end in range(1, int(sizes.max()) + 1):
            for k, (source, piece, cuts) in enumerate(arcs, 1):
                a, b = cuts[end], cuts[end + 1]
                if a < b:  # one arc of a length ends at a place, so rows are distinct
                    alpha[source[a:b] + k] += alpha[source[a:b]] * weights[piece[a:b]]
        out[few] = np.log(np.maximum(alpha[begin + sizes], 1e-300))
        return out

    def expected(self, word: str, language: int, count: float, into: dict[int, float]) -> None:
        """Adds the expected number of times that each piece is used in ``word``: a forward and a backward
        pass over log-sums, so that words of any length count."""
        n = len(word)
        arcs = [(i, j, ids, sum(math.log(max(float(self.weights[k, language]), 1e-300)) for k in ids)) for i, j, ids in self.arcs(word)]
        alpha, beta = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        alpha[0] = beta[n] = 0.0
        for i, j, _, w in arcs:  # by start, so alpha[i] is complete
            alpha[j] = _log_sum(alpha[j], alpha[i] + w)
        for i, j, _, w in reversed(arcs):
            beta[i] = _log_sum(beta[i], w + beta[j])
        for i, j, ids, w in arcs:
            share = count * math.exp(min(alpha[i] + w + beta[j] - alpha[n], 0.0))
            for k in ids:
                into[k] = into.get(k, 0.0) + share


def _log_sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


_runs = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, lower-cased. Signs such as fractions, which count as numbers and
    not as digits, part words as well."""
    words = _runs((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    return [w for x in words for w in "".join(c if c.isalpha() else " " for c in x).split()]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that is never learned from; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, vocabulary: str, max_docs: int = 400, rounds: int = 4, smoothing: float = 0.05) -> dict[str, np.ndarray]:
    """Piece probabilities by language, from the rows of ``docs`` (text, lang).

    ``max_docs`` bounds the sample: about so many documents of each language are learned from, chosen
    by a hash of the text, so that neither order nor partitions matter. Texts are used whole, and a text
    that several rows of a language repeat is learned from once.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, max_docs / n))) for k, n in counts.items()))
    chosen = docs.where(F.pmod(F.xxhash64(F.lit("langid"), "text"), F.lit(1 << 30)) < share * (1 << 30))
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text.as_py()))
            flat = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    words = chosen.distinct().mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    languages = sorted(counts)
    pieces = read_pieces(vocabulary)
    size = max(pieces.values()) + 1
    weights = np.zeros((size, len(languages)))
    weights[sorted(pieces.values())] = 1.0 / len(pieces)
    spark = docs.sparkSession
    try:
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(weights)  # languages x vocabulary doubles

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                segmenter = Segmenter(pieces, sent.value)
                total: dict[str, dict[int, float]] = {}
                for batch in short(batches):
                    for lang, word, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                        segmenter.expected(MARK + word, languages.index(lang), n, total.setdefault(lang, {}))
                flat = [(lang, k, v) for lang, found in total.items() for k, v in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.float64())], names=["lang", "piece", "n"])

            found = words.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
            weights = np.zeros_like(weights)
            weights[sorted(pieces.values())] = smoothing
            for row in found:
                weights[row["piece"], languages.index(row["lang"])] += row["n"]
            weights /= weights.sum(axis=0)
            sent.unpersist()
    finally:
        words.unpersist()
    return {lang: weights[:, k] for k, lang in enumerate(languages)}


def identify(docs: DataFrame, model: dict[str, np.ndarray], vocabulary: str, cache: int = CACHE) -> DataFrame:
    """doc_id, lang_pred, score (the posterior under equal priors) and n_letter_words of every row.

    One narrow stage: words of a batch are counted by document, each distinct word is scored once, and
    a document's log-probabilities are the sums over its words.
    """
    languages = sorted(model)
    weights = np.stack([model[k] for k in languages], axis=1) if languages else np.zeros((1, 1))
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_letter_words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(read_pieces(vocabulary), sent.value) if languages else None
        known: dict[str, int] = {}  # word -> row of table
        table = np.zeros((0, len(languages)))
        for batch in short(batches):
            counted = [Counter(words_of(t.as_py())) if languages else {} for t in batch.column(1)]
            if new := list(dict.fromkeys(w for c in counted for w in c if w not in known)):
                if len(known) + len(new) > cache:
                    known, table = {}, table[:0]
                    new = list(dict.fromkeys(w for c in counted for w in c))
                known.update((w, len(table) + k) for k, w in enumerate(new))
                table = np.vstack([table, segmenter.scores([MARK + w for w in new])])
            best, score, n_words = [], [], []
            for c in counted:
                if not c:
                    best.append("und"), score.append(0.0), n_words.append(0)
                    continue
                rows = np.fromiter(map(known.__getitem__, c), dtype=np.int64, count=len(c))
                times = np.fromiter(c.values(), dtype=np.float64, count=len(c))
                log = times @ table[rows]
                k = int(np.argmax(log))
                best.append(languages[k]), score.append(float(1 / np.exp(log - log[k]).sum())), n_words.append(int(times.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(n_words, pa.int64())], names=[f.name for f in schema])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
