"""Similarity of embeddings; products in numpy on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import CELLS, matrix, streamed_past

LABELS = (("HIGH", 0.7), ("AVERAGE", 0.4), ("LOW", 0.2))
#: More centroids than this don't belong in a broadcast.
MOST_CENTROIDS = 10_000


def cosine_similarity(a: Column, b: Column) -> Column:
    """Inside Spark, for small data; null where a norm is zero."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when(norm > 0, total(F.zip_with(a, b, lambda x, y: x * y)) / norm)


def cosine_fast(a: Column, b: Column, half: bool = False) -> Column:
    """The same on Arrow batches of equal-length vectors; ``half`` rounds to 16-bit floats first."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        p, q = np.stack(x.to_numpy()).astype(np.float64), np.stack(y.to_numpy()).astype(np.float64)
        if half:
            p, q = p.astype(np.float16).astype(np.float64), q.astype(np.float16).astype(np.float64)
        norm = np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            found = np.einsum("ij,ij->i", p, q) / norm
        return pd.Series(np.where(norm > 0, found, np.nan))

    return F.nanvl(run(a, b), F.lit(None).cast("double"))


#: Against rounding between a product of matrices and one of vectors.
SLACK = 1e-9


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x and the same row of y; not a number where a norm is zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        found = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
    return np.where(np.isfinite(found), found, np.nan)


class _Chunks:
    """A block of chunks: answers queries with its nearest ``most``."""

    def __init__(self, rows: pa.RecordBatch, most: int, low: float):
        self.rows, self.most, self.low = rows.drop_columns(["embedding"]), most, low
        self.v = matrix(rows.column("embedding"))
        norm = np.linalg.norm(self.v, axis=1, keepdims=True)
        self.unit = np.divide(self.v, norm, out=np.full_like(self.v, np.nan), where=norm > 0)

    def meet(self, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q = matrix(queries.column("embedding"))
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        near = np.nan_to_num(np.divide(q, norm, out=np.zeros_like(q), where=norm > 0) @ np.nan_to_num(self.unit).T, nan=-2.0)
        least = np.full(len(q), self.low)
        if near.shape[1] > self.most:
            least = np.maximum(least, -np.partition(-near, self.most - 1, axis=1)[:, self.most - 1])
        who, which = np.nonzero(near >= least[:, None] - SLACK)
        exact = _cosines(self.v[which], q[who])
        good = exact >= self.low
        who, which, exact = who[good], which[good], exact[good]
        yield pa.RecordBatch.from_arrays([queries.column("query_id").take(pa.array(who)), *(self.rows.column(c).take(pa.array(which)) for c in ("email_id", "chunk_index", "chunk_text")), pa.array(exact)], names=["query_id", "email_id", "chunk_index", "chunk_text", "similarity"])

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def search_embeddings(emb: DataFrame, queries: DataFrame, limit: int = 10, min_similarity: float = 0.3, cells: int = CELLS) -> DataFrame:
    """query_id, email_id, best_similarity, chunks (text, similarity; best first), position.

    Each query sees its user's chunks: these lie in blocks as matrices of about ``cells`` components, queries
    go to their user's blocks, and one product scores a batch of queries against a block. A block answers
    with its best 3 * limit chunks of a query, and ties with the last of them. Users, chunks and queries
    without a vector take no part; a user's vectors are of one length.
    """
    limit = max(1, min(limit, 50))
    low = min(max(min_similarity, 0.0), 1.0)
    chunks = emb.where(F.col("embedding").isNotNull()).select("user_id", "email_id", "chunk_index", "chunk_text", "embedding")
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "user_id", "embedding")
    one = chunks.select(F.size("embedding").alias("d")).first()
    rows = max(64, cells // max(1, one["d"] if one else 1))
    kinds = chunks.schema
    schema = T.StructType([asked.schema["query_id"], kinds["email_id"], kinds["chunk_index"], kinds["chunk_text"], T.StructField("similarity", T.DoubleType())])
    sim = streamed_past(chunks, asked, ["user_id"], ["email_id", "chunk_index"], rows, lambda part: _Chunks(part, 3 * limit, low), schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "email_id", "chunk_index")
    top = sim.withColumn("r", F.row_number().over(best)).where((F.col("r") <= 3 * limit) & F.col("chunk_text").isNotNull())
    chunks = F.transform(F.array_sort(F.collect_list(F.struct("r", "chunk_text", "similarity"))), lambda c: F.struct(c["chunk_text"].alias("text"), c["similarity"].alias("similarity")))
    grouped = top.groupBy("query_id", "email_id").agg(F.max("similarity").alias("best_similarity"), chunks.alias("chunks"))
    final = Window.partitionBy("query_id").orderBy(F.desc("best_similarity"), "email_id")
    return grouped.withColumn("position", F.row_number().over(final)).where(F.col("position") <= limit)


def similarity_label(c: Column) -> Column:
    out = F.lit("DISSIMILAR")
    for label, least in reversed(LABELS):
        out = F.when(c >= least, label).otherwise(out)
    return out


def pairwise_similarity(emb: DataFrame, by: str, key: str) -> DataFrame:
    """by, a, b (a < b), similarity, label: the unordered pairs inside each value of ``by``, such as
    the chunks of one email. The pairs are the result, so groups have to be small."""
    left = emb.select(by, F.col(key).alias("a"), F.col("embedding").alias("x"))
    right = emb.select(by, F.col(key).alias("b"), F.col("embedding").alias("y"))
    pairs = left.join(right, by).where("a < b").select(by, "a", "b", cosine_fast(F.col("x"), F.col("y")).alias("similarity"))
    return pairs.withColumn("label", similarity_label(F.col("similarity")))


def mean_similarity(emb: DataFrame, by: str) -> DataFrame:
    """by, n, mean_similarity over all pairs of a group, without making pairs: the squared length of
    the sum of unit vectors holds every pair's cosine twice. Partial sums by dimension, so groups of
    any size work."""
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = emb.withColumn("__n", norm).where("__n > 0").select(by, F.posexplode(F.transform(v, lambda x: x / F.col("__n"))).alias("d", "x"))
    sums = unit.groupBy(by, "d").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy(by).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).where("n > 1").select(by, "n", ((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_similarity"))


def best_two(unit: np.ndarray, names: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows among named vectors: the best score, its name (of equal scores the first in order of
    names), and the second best score. A single vector has 0 for the second."""
    score = vectors @ unit.T
    best = score.argmax(axis=1)
    top = score[np.arange(len(score)), best]
    second = np.partition(score, -2, axis=1)[:, -2] if score.shape[1] > 1 else np.full(len(score), np.nan)
    return top, names[best], second


class _Rows:
    """A block of rows, met by blocks of centroids: holds the best two of each row so far."""

    def __init__(self, rows: pa.RecordBatch, least: float, margin: float):
        self.rows, self.least, self.margin = rows, least, margin
        v = matrix(rows.column("embedding"))
        self.v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        self.top, self.name, self.second = np.full(len(v), -np.inf), np.full(len(v), None, dtype=object), np.full(len(v), -np.inf)

    def meet(self, centroids: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = np.array(centroids.column("label").to_pylist(), dtype=object)
        order = np.argsort(names)
        c = matrix(centroids.column("embedding"))[order]
        top, name, second = best_two(c / np.linalg.norm(c, axis=1, keepdims=True), names[order], self.v)
        second = np.where(np.isnan(second), -np.inf, second)
        better = (top > self.top) | (top == self.top) & (name < np.where(self.name == None, "\U0010ffff", self.name))  # noqa: E711
        self.second = np.maximum(np.where(better, self.top, top), np.maximum(self.second, second))
        self.top, self.name = np.where(better, top, self.top), np.where(better, name, self.name)
        return iter(())

    def end(self) -> Iterator[pa.RecordBatch]:
        second = np.where(np.isinf(self.second), 0.0, self.second)
        good = (self.top >= self.least) & (self.top - second >= self.margin)
        label = np.where(good, self.name, "uncategorized")
        yield pa.RecordBatch.from_arrays([*self.rows.columns, pa.array(label.tolist(), pa.string()), pa.array(self.top)], names=[*self.rows.schema.names, "label", "score"])


def classify_in_blocks(emb: DataFrame, centroids: DataFrame, least: float = 0.30, margin: float = 0.05, cells: int = CELLS) -> DataFrame:
    """As ``classify_by_centroid``, for any number of centroids: rows lie in blocks, and batches of centroids
    are streamed past each block, which keeps the best two scores of a row. Equal rows share a block."""
    kept = emb.select(*(c for c in emb.columns if c not in ("label", "score")))
    one = centroids.select(F.size("embedding").alias("d")).first()
    rows = max(64, cells // max(1, one["d"]))
    schema = T.StructType([*kept.schema.fields, T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
    marked = kept.withColumn("__all", F.lit(0))
    told = [f.name for f in kept.schema if not isinstance(f.dataType, T.MapType)]
    passing = centroids.select(F.col("label").cast("string").alias("label"), "embedding").withColumn("__all", F.lit(0))
    return streamed_past(marked, passing, ["__all"], told, rows, lambda part: _Rows(part.drop_columns(["__all"]), least, margin), schema)


def classify_by_centroid(emb: DataFrame, centroids: DataFrame, least: float = 0.30, margin: float = 0.05, most: int = MOST_CENTROIDS) -> DataFrame:
    """Adds label and score: the best centroid if it is good enough and clear of the second, else
    uncategorized; the score is always the best. ``centroids``: label, embedding. Up to ``most`` of them are
    broadcast; more are met in blocks."""
    rows = centroids.select(F.col("label").cast("string").alias("label"), "embedding").orderBy("label").limit(most + 1).collect()
    if not rows:
        raise ValueError("there are no centroids")
    if len(rows) > most:
        return classify_in_blocks(emb, centroids, least, margin)
    names = np.array([r["label"] for r in rows], dtype=object)
    unit = np.array([r["embedding"] for r in rows], dtype=np.float64)
    sent = emb.sparkSession.sparkContext.broadcast((names, unit / np.linalg.norm(unit, axis=1, keepdims=True)))

    @F.pandas_udf(T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(s: pd.Series) -> pd.DataFrame:
        if not len(s):
            return pd.DataFrame({"label": pd.Series([], dtype=object), "score": pd.Series([], dtype="float64")})
        names, unit = sent.value
        x = np.stack(s.to_numpy()).astype(np.float64)
        top, name, second = best_two(unit, names, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
        good = (top >= least) & (top - np.nan_to_num(second) >= margin)
        return pd.DataFrame({"label": np.where(good, name, "uncategorized"), "score": top})

    kept = [c for c in emb.columns if c not in ("label", "score")]
    return emb.withColumn("__c", run(F.col("embedding"))).select(*kept, "__c.label", "__c.score")
