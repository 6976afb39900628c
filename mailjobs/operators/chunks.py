"""Sentence chunks for embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import numbered

#: Longest chunk, in bytes of UTF-8.
LONGEST = 32_768


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_bytes(c: Column, n: int) -> Column:
    """The longest beginning of a text that isn't longer than n bytes and ends with a whole character."""
    raw = c.cast("binary")
    following = F.hex(F.substring(raw, n + 1, 1))  # 80 to BF: the cut is inside a character
    whole = F.length(F.substring(raw, 1, n).cast("string")) - F.when(following.between("80", "BF"), 1).otherwise(0)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.substring(c, F.lit(1), whole))


def chunk_array(c: Column) -> Column:
    """The chunks of a text: sentences and what stands between link marks, if two letters meet in them."""
    cut = F.split(F.regexp_replace(_trimmed(c), r"(?U)([.!?])\s+|\[LINK\]", "$1\x01"), "\x01")
    kept = F.filter(F.transform(cut, _trimmed), lambda s: s.rlike(r"\p{IsAlphabetic}{2}"))
    return F.coalesce(F.transform(kept, lambda s: first_bytes(s, LONGEST)), F.array().cast("array<string>"))


def chunk_text(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """keep columns, chunk_index (from 0), chunk_text."""
    return df.select(*keep, F.posexplode(chunk_array(F.col(column))).alias("chunk_index", "chunk_text"))


def chunk_email(df: DataFrame, subject: str, body: str, *keep: str) -> DataFrame:
    """Subject chunks, then body chunks, numbered on."""
    both = F.concat(chunk_array(F.col(subject)), chunk_array(F.col(body)))
    return df.select(*keep, F.posexplode(both).alias("chunk_index", "chunk_text"))


def should_embed(df: DataFrame) -> DataFrame:
    return df.where("priority >= 2")


def embedding_batches(chunks: DataFrame, size: int, by: str, *order: str) -> DataFrame:
    """by, batch, chunks: batches of ``size`` in order, inside each value of ``by``. The first order
    column is numeric."""
    numbers = numbered(chunks, [by], list(order), "__at").withColumn("batch", F.floor((F.col("__at") - 1) / size).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("__at", "chunk_text")))
    return numbers.groupBy(by, "batch").agg(F.transform(rows, lambda r: r["chunk_text"]).alias("chunks"))
