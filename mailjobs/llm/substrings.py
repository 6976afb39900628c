"""Substring deduplication by hashing lines and stretches of sentences.

Every whole text is cut into units: its lines of several sentences, and at each sentence the stretch that
begins there and takes in as many sentences, over line ends too, as make ``min_words`` words. So a short
line or sentence is compared together with what follows it, wherever it stands, and no cut depends on the
text before it. A unit is normalised (lower case, white space runs to one blank) and digested to 128 bits.
Digests are grouped over all documents. The occurrence that ranks first by (doc_id, start) stays, all
others are removed, and their offsets in the original text (code points, end exclusive) are kept.
Stretches overlap, so what is removed of a repeated passage is all but fewer than ``min_words`` words at
its end and a sentence cut at either end; a repeated line or sentence that is shorter stays, since it
recurs in texts that have nothing else in common.

Scale: units are written once (Parquet, in the shared folder); digests are counted with partial
aggregation, so a line of a third of all documents sends one row for each task; only digests found more
than once are joined back to the units.

Defined results: a null or empty text has no units; rows that agree in doc_id and text are one
document to the ranking (both keep or lose the same units), so repeated rows give repeated rows; a null
doc_id ranks first; other columns take no part, and ``removed`` keeps those of its input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, let, replaced, running, short, stored

_words = re.compile(r"[^ \t\n\r\f\v]+").findall
#: Between a full stop, question or exclamation mark and the white space that follows it.
_ends = re.compile(r"(?<=[.!?])(?=[ \t\r\f\v])").split
BLANKS = " \t\n\r\f\v"


def units(text: str, min_words: int) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of every unit of a text, by start."""
    from xxhash import xxh128_digest

    starts, ends, sizes, texts = [], [], [], []  # of each sentence
    found: dict[tuple[int, int], str] = {}
    begin = 0
    for line in text.split("\n"):
        first, at = len(starts), begin
        for x in _ends(line):
            if words := _words(x.lower()):
                starts.append(at + len(x) - len(x.lstrip(BLANKS)))
                ends.append(at + len(x.rstrip(BLANKS)))
                sizes.append(len(words))
                texts.append(" ".join(words))
            at += len(x)
        if len(starts) > first + 1 and sum(sizes[first:]) >= min_words:
            found[starts[first], ends[-1]] = " ".join(texts[first:])
        begin += len(line) + 1
    last = n = 0
    for k in range(len(starts)):
        while last < len(starts) and n < min_words:
            n += sizes[last]
            last += 1
        if n < min_words:
            break
        found[starts[k], ends[last - 1]] = " ".join(texts[k:last])
        n -= sizes[k]
    return [(a, b, xxh128_digest(t.encode("utf-8", "replace"))) for (a, b), t in sorted(found.items())]


def text_key(text: Column) -> Column:
    """With doc_id, what a document is known by."""
    return F.xxhash64(text)


def unit_table(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """doc_id, key, d1, d2 (the digest), start and end of every unit; one narrow stage."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("key", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            found = [units(t.as_py() or "", min_words) for t in batch.column(2)]
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            digests = np.frombuffer(b"".join(u[2] for x in found for u in x), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([u[0] for x in found for u in x], pa.int32()), pa.array([u[1] for x in found for u in x], pa.int32())],
                names=[f.name for f in schema],
            )

    return docs.select("doc_id", text_key(F.col("text")).alias("key"), "text").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """doc_id, key and ``spans``: for each document that loses something, the spans to remove, sorted
    by start, with the doc_id and start of the occurrence that stays."""
    rows, _ = stored(unit_table(docs, min_words))
    first = F.min(F.struct("doc_id", "key", "start")).alias("first")
    again = checkpointed(rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1").drop("n"))
    own = F.struct("doc_id", "key", "start")
    lost = rows.join(again, ["d1", "d2"]).where(~own.eqNullSafe(F.col("first")))
    span = F.struct("start", "end", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))
    return lost.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(span)).alias("spans"))


def _joined(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (with a key column named __key) and the spans of each row, or null."""
    there = spans.select(F.col("doc_id").alias("__doc_id"), F.col("key").alias("__of"), F.col("spans").alias("__spans"))
    return docs.join(there, docs["doc_id"].eqNullSafe(F.col("__doc_id")) & (F.col("__key") == F.col("__of")), "left")


def merged(spans: Column) -> Column:
    """Spans (start, end) sorted by start, overlaps joined into one."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def whole(ss: Column) -> Column:
        ends = F.transform(ss, lambda s: s["end"])
        fresh = F.filter(F.zip_with(ss, running(ends, F.greatest, -1), lambda s, e: F.struct(s["start"].alias("start"), e.alias("before"))), lambda x: x["start"] > x["before"])
        # A joined span ends at the furthest end before the next one begins.
        return let(F.struct(fresh.alias("fresh"), F.array_max(ends).alias("last")), lambda w: F.zip_with(w["fresh"], F.concat(F.transform(F.slice(w["fresh"], 2, F.size(w["fresh"])), lambda x: x["before"]), F.array(w["last"])), lambda x, e: F.struct(x["start"].alias("start"), e.alias("end"))))

    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, none).otherwise(let(spans, whole).cast("array<struct<start:int,end:int>>"))


def report(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_removed (units), n_removed_chars, kept_chars and
    ``removed``, the removed stretches with their original offsets."""
    slim = docs.select("doc_id", text_key(F.col("text")).alias("__key"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("__chars"))
    rows = _joined(slim, repeated_spans(docs, min_words)).withColumn("removed", merged(F.col("__spans")))
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    return rows.select("doc_id", F.coalesce(F.size("__spans"), F.lit(0)).cast("long").alias("n_removed"), cut.alias("n_removed_chars"), (F.col("__chars") - cut).alias("kept_chars"), "removed")


def removed(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """All columns of ``docs`` with the repeated stretches cut out of ``text``, and ``removed``."""
    rows = _joined(docs.withColumn("__key", text_key(F.col("text"))), repeated_spans(docs, min_words)).withColumn("__cut", merged(F.col("__spans")))

    def without(spans: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(F.slice(spans, 1, F.size(spans) - 1), lambda s: s["end"]))
        return replaced(F.col("text"), F.zip_with(spans, begins, lambda s, b: F.struct(b.alias("begin"), s["start"].alias("start"))), F.element_at(spans, -1)["end"], "")

    rest = let(F.col("__cut"), without)
    kept = [F.when(F.size("__cut") > 0, rest).otherwise(F.col("text")).alias("text") if c == "text" else docs[c] for c in docs.columns if c != "removed"]
    return rows.select(*kept, F.col("__cut").alias("removed"))
