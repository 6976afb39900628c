import pytest

#: Documents that hold the odd cases: nulls, empty and long texts, repeated rows, ties.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog again and again today", None, None),
    (3, None, "en", "a"),
    (4, "", "de", "b"),
    (None, "eine kleine Nachtmusik für alle Leute in der großen Stadt am Fluss heute", "de", "b"),
    (5, "   \n\t ", "fr", None),
    (6, "12345 67890 !!! ???", None, "c"),
    (7, "wort " * 30_000, "de", "c"),
    (8, "x" * 100_000, "en", "c"),
    (9, "ligne un de ce texte assez long pour compter ici\nligne un de ce texte assez long pour compter ici\nfin", "fr", "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents with extra columns whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    clash = ("size", "taken", "fp", "score", "key", "start", "spans", "fail_bits", "host", "copies", "place", "order", "removed_spans")
    return docs.withColumns({c: F.lit("clash") for c in clash}).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
