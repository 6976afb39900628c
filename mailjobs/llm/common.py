"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of characters other than blank and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a Python stage works on at once. Spark bounds the bytes of an Arrow batch besides.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of no more than ``rows``, without a copy."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, host).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty where there is no ://."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, the one of ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary one; a cluster has to name it, since a machine-local folder goes with its
    executor."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="mailjobs-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows written as Parquet in the shared folder and read again, and where they lie: as a
    checkpoint, but compressed, read by column, and free to be removed once nothing reads it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what ``stored`` wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def count_words(text: Column) -> Column:
    """Number of words of the contracts; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Elements folded into one another directly; longer arrays are folded in blocks of as many.
BLOCK = 256


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op, first: int) -> Column:
    """For each element of an array<int> the fold of ``first`` and the elements before it. Arrays grow
    inside blocks only, so that long ones take time in proportion to their length."""

    def fold(v: Column) -> Column:
        return F.aggregate(v, F.array(F.lit(first)).cast("array<int>"), lambda done, x: F.concat(done, F.array(op(F.element_at(done, -1), x))))

    def joined(parts: Column) -> Column:
        before = fold(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda p, b: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: op(b, x))))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(v), F.lit(BLOCK)), lambda at: fold(F.slice(v, at, BLOCK)))
        return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(let(blocks, joined))

    return let(values.cast("array<int>"), whole)


def replaced(text: Column, cuts: Column, end: Column, marker: str) -> Column:
    """``text`` with a marker for each of ``cuts``, an array of (begin, start): what stands between the end
    of the cut before and its own start; the last cut ends at ``end``. Cuts are taken in blocks, so that
    no place is looked up from the text's beginning for each of them."""

    def block(c: Column) -> Column:
        base = F.element_at(c, 1)["begin"]
        piece = F.substring(text, base + 1, F.element_at(c, -1)["start"] - base)
        return let(piece, lambda p: F.array_join(F.transform(c, lambda x: F.concat(F.substring(p, x["begin"] - F.element_at(c, 1)["begin"] + 1, x["start"] - x["begin"]), F.lit(marker))), ""))

    def whole(c: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(c), F.lit(BLOCK)), lambda at: let(F.slice(c, at, BLOCK), block))
        return F.concat(F.array_join(blocks, ""), F.substring(text, end + 1, F.length(text)))

    return F.when(F.size(cuts) == 0, text).otherwise(let(cuts, whole))
