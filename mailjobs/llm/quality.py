"""Quality rules as a bitmask ledger.

``ledger`` measures every whole text once and evaluates every rule once; it stores the measurements
and one failure bit for each rule. A policy is a named, versioned set of rules, hence one mask:
applying it, or comparing policies, is bitwise work on the ledger and reads no text again.

Defined results: a null or empty text has no words, so all measurements are 0 and the rules see 0;
repeated rows give repeated rows; ties don't arise; columns beyond doc_id and text take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, short

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_exclaim")

#: (name, SQL condition on the measurements that fails a document); the position is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("shouting", "2 * n_upper_words > n_words"),
    ("exclamations", "2 * n_exclaim > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
)

#: Versioned policies: which rules reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": tuple(name for name, _ in RULES),
}

_words = re.compile(WORD).findall
_has_word = re.compile(WORD).search


def repeat_words(words: list[str], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more, the first one included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    order: dict[str, int] = {}
    ids = np.fromiter((order.setdefault(w, len(order)) for w in words), dtype=np.int64, count=len(words))
    base = len(order)
    keys, span = ids[:n].copy(), base
    for k in range(1, size):
        if span * base >= 2**62:  # the next digit would overflow: number the windows so far anew
            _, keys = np.unique(keys, return_inverse=True)
            span = int(keys.max()) + 1
        keys = keys * base + ids[k : k + n]
        span *= base
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    text = text or ""
    words = _words(text)
    lines = [x for x in text.split("\n") if _has_word(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, "#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        sum(map(str.isupper, words)),
        text.count("!"),
    )


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES for every row; one narrow stage."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            rows = np.array([measure(t.as_py()) for t in batch.column(1)], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(MEASURES)))], names=[f.name for f in schema])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def bits(rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The failure bits of a row of measurements."""
    out = F.lit(0).cast("long")
    for k, (_, condition) in enumerate(rules):
        out = out.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``."""
    return measurements(docs).withColumn("fail_bits", bits(rules))


def mask(policy: tuple[str, ...], rules: tuple[tuple[str, str], ...] = RULES) -> int:
    names = [name for name, _ in rules]
    return sum(1 << names.index(name) for name in policy)


def apply_policy(rows: DataFrame, policy: tuple[str, ...], into: str = "kept", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Adds a boolean: true if no rule of the policy fails the row."""
    return rows.withColumn(into, F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0)


def ablations(rows: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """For each policy and rule of it: documents failed, failed by this rule alone, and how many the
    policy rejects. The ledger is first counted by bit pattern (partial aggregation; at most
    2 ** len(rules) rows leave it), all else works on those counts."""
    names = [name for name, _ in rules]
    wanted = [(version, name, 1 << names.index(name), mask(policy, rules)) for version, policy in policies.items() for name in policy]
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*(F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit"), F.lit(m).cast("long").alias("mask")) for v, r, b, m in wanted))
    hit = F.col("fail_bits").bitwiseAND(F.col("w.mask"))
    return (
        patterns.select("fail_bits", "n", F.explode(each).alias("w"))
        .groupBy(F.col("w.policy").alias("policy"), F.col("w.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("w.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(hit == F.col("w.bit"), F.col("n"))), F.lit(0)).alias("n_only_this"),
            F.coalesce(F.sum(F.when(hit != 0, F.col("n"))), F.lit(0)).alias("n_rejected"),
        )
    )


def annotate(docs: DataFrame, text: str = "text", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """All columns of ``docs`` and ``fail_bits`` (in place of one of that name), without a join: the
    measurements travel with the row."""
    docs = docs.drop("fail_bits")
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(f"__{m}", T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            rows = np.array([measure(t.as_py()) for t in batch.column(place)], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rows[:, k]) for k in range(len(MEASURES)))], names=[f.name for f in schema])

    own = tuple((name, re.sub(r"[a-z]\w+", lambda m: f"__{m[0]}" if m[0] in MEASURES else m[0], condition)) for name, condition in rules)
    return docs.mapInArrow(run, schema).select(*docs.columns, bits(own).alias("fail_bits"))
