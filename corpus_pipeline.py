"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, byte-level BPE.

``run`` applies the stages to documents; each stage works on all rows that the one before it kept, and
sees each of them as it was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailjobs.llm import bpe, mixing, nearcopies, quality, secrets
from mailjobs.llm.common import remove, stored, table
from mailjobs.llm.queries import BPE_FILE, bpe_pattern, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the newest policy rejects."""
    kept = quality.apply_policy(quality.annotate(docs, "text"), quality.POLICIES["v2"]).where("kept")
    return kept.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more in 5-word shingles: the one
    with the smallest doc_id."""
    return nearcopies.deduplicated(docs).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every found secret replaced by a marker."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each whole and as often as the mix reads it; the copy at which a
    source's target ends is there if half of it lies before that end."""
    return mixing.materialise(docs, cut=False).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every whole text."""
    return bpe.encode_documents(docs, vocabulary(BPE_FILE), bpe_pattern()).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("byte BPE", byte_bpe),
]

#: SQL can't express the last stage; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written to the shared folder once and read by the
    next one; a stage's rows are deleted when the stage after it has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir))
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
