"""Periodic runs of words, found on a Re-Pair grammar of each text.

A run is a longest stretch with smallest period q and at least ``max(least, times * q)`` words. Re-Pair
replaces the most frequent pair of neighbouring symbols until none repeats; what is left is paired up as a
balanced tree. Every run lies in the text of a smallest symbol that holds it whole, and crosses the boundary
between that symbol's two parts. So the runs crossing each symbol's boundary are computed once a symbol,
carried to all places where the symbol is derived, and merged: stretches of one period that share a period
are one.

Only stretches that can hold a run are compressed. In a run of 4 periods and 6 words, every five words in
a row come again a period later or earlier, and no fewer than twice the period of them begin one after
another. Stretches without that, at any scale of the period, hold no run. That leaves whole runs and little
else, and looks at each word a fixed number of times for each scale.

Scale: a text is worked on by itself, in one narrow stage without a shuffle. Memory follows the longest
text; time is near to n log n, and proportional to the words outside candidate stretches.

Defined results: a null text has no words, no runs, and an empty collapsed text; repeated rows give repeated
rows; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WORD, short

#: Words and periods that a stretch needs to be a run.
LEAST, TIMES = 6, 4
#: Words in a row whose repetition tells where runs can be; not more than fit LEAST and TIMES.
GRAM = 5

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
_words = re.compile(WORD).findall


def gram_names(ids: np.ndarray) -> np.ndarray:
    """A number for each stretch of GRAM words, equal for equal stretches."""
    names = ids
    width = 1
    while width < GRAM:
        step = min(width, GRAM - width)
        left, right = names[:-step], names[step:]
        _, names = np.unique(left.astype(np.int64) * (int(names.max(initial=0)) + 1) + right, return_inverse=True)
        width += step
    return names


def near_repeat(names: np.ndarray) -> np.ndarray:
    """How far the nearest equal name is from each place; the length where there is none."""
    order = np.argsort(names, kind="stable")
    gap = np.where(names[order[1:]] == names[order[:-1]], order[1:] - order[:-1], len(names))
    out = np.full(len(names), len(names))
    out[order[1:]] = gap
    out[order[:-1]] = np.minimum(out[order[:-1]], gap)
    return out


def candidates(ids: np.ndarray) -> list[tuple[int, int]]:
    """The disjoint stretches (from, to) that hold all runs."""
    if len(ids) < LEAST:
        return []
    near = near_repeat(gram_names(ids))
    if near.min() > len(ids) // TIMES:
        return []
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    scale = 1
    while scale < 2 * max(1, len(ids) // TIMES):  # periods over half of scale, up to scale
        close = np.concatenate([[False], near <= scale, [False]])
        change = np.flatnonzero(close[1:] != close[:-1])
        first, end = change[::2], change[1::2]
        least = max(LEAST, TIMES * (scale // 2 + 1)) - GRAM + 1
        long = end - first >= least
        np.add.at(edges, first[long], 1)
        np.add.at(edges, end[long] + GRAM - 1, -1)
        scale *= 2
    inside = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))


class Grammar:
    """Re-Pair: ``pairs[k]`` are the two symbols that symbol ``terminals + k`` stands for; ``top`` is a symbol
    for the whole sequence. ``size`` is the number of terminals of each symbol."""

    def __init__(self, ids: list[int]):
        self.terminals = max(ids, default=0) + 1
        self.pairs: list[tuple[int, int]] = []
        self.size = [1] * self.terminals
        left = self._repair(list(ids))
        while len(left) > 1:  # the rest, paired up as a balanced tree
            left = [self._symbol(*left[k : k + 2]) if k + 1 < len(left) else left[k] for k in range(0, len(left), 2)]
        self.top = left[0] if left else None

    def _symbol(self, a: int, b: int) -> int:
        self.pairs.append((a, b))
        self.size.append(self.size[a] + self.size[b])
        return self.terminals + len(self.pairs) - 1

    def _repair(self, seq: list[int]) -> list[int]:
        """The sequence with its most frequent pair replaced until no pair is left twice. ``seq`` keeps its
        places: a merged pair stands at its first one, the other becomes empty."""
        n = len(seq)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[tuple[int, int], set[int]] = {}
        for k in range(n - 1):
            pair = seq[k], seq[k + 1]
            at = places.setdefault(pair, set())
            if pair[0] != pair[1] or k - 1 not in at:
                at.add(k)
        made = {pair: k for k, pair in enumerate(places)}  # ties: the pair seen first
        heap = [(-len(at), made[pair], pair) for pair, at in places.items() if len(at) > 1]
        heapify(heap)
        while heap:
            count, _, pair = heappop(heap)
            at = places.get(pair)
            if at is None or len(at) < 2:
                continue
            if len(at) != -count:
                heappush(heap, (-len(at), made[pair], pair))
                continue
            a, b = pair
            symbol, touched = self._symbol(a, b), set()
            for k in sorted(at):
                j = after[k]
                if seq[k] != a or j >= n or seq[j] != b:
                    continue
                h, m = before[k], after[j]
                if h >= 0:
                    self._drop(places, (seq[h], a), h)
                if m < n:
                    self._drop(places, (b, seq[m]), j)
                seq[k], seq[j] = symbol, -1
                after[k] = m
                if m < n:
                    before[m] = k
                if h >= 0:
                    touched.add(self._add(places, (seq[h], symbol), h, before[h], seq))
                if m < n:
                    touched.add(self._add(places, (symbol, seq[m]), k, h, seq))
            del places[pair]
            for new in touched:
                at = places.get(new)
                if at is not None and len(at) > 1:
                    heappush(heap, (-len(at), made.setdefault(new, len(made)), new))
        return [x for x in seq if x >= 0]

    @staticmethod
    def _drop(places: dict, pair: tuple[int, int], k: int) -> None:
        if at := places.get(pair):
            at.discard(k)

    @staticmethod
    def _add(places: dict, pair: tuple[int, int], k: int, h: int, seq: list[int]) -> tuple[int, int]:
        at = places.setdefault(pair, set())
        if pair[0] != pair[1] or h not in at:
            at.add(k)
        return pair


class Text:
    """A sequence with what is needed to tell how far a period goes."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.words = ids, ids.tolist()
        self.name = gram_names(ids).tolist() if len(ids) >= GRAM else []
        self.at: dict[int, list[int]] = {}
        for k, name in enumerate(self.name):
            self.at.setdefault(name, []).append(k)

    def ahead(self, p: int, q: int, end: int) -> int:
        """The first place from p on, before ``end``, that differs from the one q behind it; else ``end``."""
        step = 16
        while p < end:
            stop = min(end, p + step)
            differ = self.ids[p:stop] != self.ids[p - q : stop - q]
            k = int(differ.argmax())
            if differ[k]:
                return p + k
            p, step = stop, step * 4
        return end

    def back(self, p: int, q: int, begin: int) -> int:
        """The last place before p, from ``begin`` on, such that it and all up to p equal those q ahead."""
        step = 16
        while p > begin:
            stop = max(begin, p - step)
            differ = (self.ids[stop:p] != self.ids[stop + q : p + q])[::-1]
            k = int(differ.argmax())
            if differ[k]:
                return p - k
            p, step = stop, step * 4
        return begin

    def crossing(self, begin: int, p: int, end: int) -> list[tuple[int, int, int]]:
        """The runs (start, end, period) inside begin to end that hold the words on both sides of place p and
        are not part of a longer one there."""
        out: list[tuple[int, int, int]] = []
        most = (end - begin) // TIMES
        if most < 1 or end - begin < LEAST:
            return out
        for q in range(1, min(most, GRAM - 1) + 1):
            self._try(begin, p, end, q, out)
        # A longer period repeats the five words from p on a period later, or those up to p one earlier.
        later, earlier = [], []
        if p + GRAM <= end and most >= GRAM:
            later = self.at[self.name[p]]
        if p - GRAM >= begin and most >= GRAM:
            earlier = self.at[self.name[p - GRAM]]
        if later:
            k = bisect_left(later, p + GRAM)
            while k < len(later) and later[k] <= p + most:
                q = later[k] - p
                # Squares inside a run already known have a multiple of its period.
                reach = max((e for s, e, r in out if s <= p and p + 2 * q <= e), default=0)
                if reach:
                    k = bisect_right(later, p + (reach - p) // 2)
                    continue
                self._try(begin, p, end, q, out)
                k += 1
        if earlier:
            k = bisect_right(earlier, p - GRAM - GRAM) - 1
            while k >= 0 and earlier[k] >= p - GRAM - most:
                q = p - GRAM - earlier[k]
                # As above; a longer period found later on may itself be a multiple of this one.
                reach = min((s for s, e, r in out if r <= q and e >= p and s <= p - 2 * q), default=None)
                if reach is not None:
                    k = bisect_left(earlier, p - GRAM - (p - reach) // 2) - 1
                    continue
                self._try(begin, p, end, q, out)
                k -= 1
        return out

    def _try(self, begin: int, p: int, end: int, q: int, out: list[tuple[int, int, int]]) -> None:
        found = []
        if p - 1 + q < end and self.words[p - 1] == self.words[p - 1 + q]:
            found.append((self.back(p - 1, q, begin), self.ahead(p - 1 + q, q, end)))
        if p - q >= begin and self.words[p - q] == self.words[p]:
            found.append((self.back(p - q, q, begin), self.ahead(p, q, end)))
        for first, last in found:
            if first < p < last and last - first >= max(LEAST, TIMES * q) and not any(s <= first and last <= e and q % r == 0 for s, e, r in out):
                out.append((first, last, q))


def grammar_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence, by start, then period."""
    text, grammar = Text(ids), Grammar(ids.tolist())
    if grammar.top is None:
        return []
    first = grammar.terminals
    # One place of each symbol, from the top down; then the runs of each from the bottom up.
    place: dict[int, int] = {grammar.top: 0}
    for symbol in range(first + len(grammar.pairs) - 1, first - 1, -1):
        if symbol in place:
            a, b = grammar.pairs[symbol - first]
            place.setdefault(a, place[symbol])
            place.setdefault(b, place[symbol] + grammar.size[a])
    own: dict[int, list[tuple[int, int, int]]] = {}
    holds: set[int] = set()
    for symbol in range(first, first + len(grammar.pairs)):
        a, b = grammar.pairs[symbol - first]
        begin, size = place[symbol], grammar.size[symbol]
        found = text.crossing(begin, begin + grammar.size[a], begin + size) if size >= LEAST else []
        if found:
            own[symbol] = [(s - begin, e - begin, q) for s, e, q in found]
        if found or a in holds or b in holds:
            holds.add(symbol)
    runs, waiting = set(), [(grammar.top, 0)]
    while waiting:
        symbol, begin = waiting.pop()
        if symbol not in holds:
            continue
        runs.update((q, begin + s, begin + e) for s, e, q in own.get(symbol, ()))
        a, b = grammar.pairs[symbol - first]
        waiting += [(a, begin), (b, begin + grammar.size[a])]
    return sorted(primitive(merged(runs)))


def merged(runs: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches (period, start, end) of one period that share a period or more are one; as (start, length,
    period)."""
    out: list[list[int]] = []
    for q, start, end in sorted(runs):
        if out and out[-1][0] == q and start + q <= out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([q, start, end])
    return [(start, end - start, q) for q, start, end in out]


def primitive(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Without those that a stretch of a smaller period, a divisor of theirs, holds."""
    out: list[tuple[int, int, int]] = []
    reach: dict[int, list[tuple[int, int]]] = {}
    for start, length, q in sorted(runs, key=lambda r: r[2]):
        inside = False
        for r, known in reach.items():
            if q % r == 0:
                k = bisect_right(known, (start, float("inf"))) - 1
                inside |= k >= 0 and known[k][1] >= start + length
        if not inside:
            out.append((start, length, q))
            reach.setdefault(q, []).append((start, start + length))
    return out


def word_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text's words."""
    if len(words) < LEAST:
        return []
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    out = []
    for begin, end in candidates(ids):
        _, part = np.unique(ids[begin:end], return_inverse=True)
        out += [(begin + start, length, q) for start, length, q in grammar_runs(part)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by a blank, without those that a run holds after its first period."""
    if not runs:
        return " ".join(words)
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        drop[start + q] += 1
        drop[start + length] -= 1
    return " ".join(w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then period) and ``collapsed``, the
    text without the repetitions, of every whole text."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 100):
            n, runs, texts = [], [], []
            for text in batch.column(1):
                words = _words(text.as_py() or "")
                found = word_runs(words)
                n.append(len(words))
                runs.append([dict(zip(RUN.names, r, strict=True)) for r in found])
                texts.append(collapsed(words, found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], names=[f.name for f in schema])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
