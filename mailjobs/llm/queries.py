"""The registered queries of this package: thin uses of its operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hardnegatives, langid, mixing, neighbours, pages, quality, runs, secrets, simhash, substrings, tokencounts, urls
from .common import WORD, let, table

#: Where the public vocabularies lie, by the package that ships them.
BPE_FILE = "byte_bpe_50k.tiktoken"
PIECES_FILE = "piece_bpe_32k.model"
COUNTED_FILE = "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    path = vocabulary(PIECES_FILE)
    found = langid.identify(docs.select("doc_id", "text"), langid.train(learn, path), path)
    return found.withColumn("held_out", langid.held_out(F.col("doc_id")))


#: The rules of the url query: what they name, and their verdict.
RULES = [("net/", urls.BLOCK), ("example.net/en/", urls.ALLOW), ("example.com/de/", urls.BLOCK), ("org/fr/", urls.ALLOW)]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.by_position(mixing.curriculum(table(spark, sf_dir, "documents")))
    positions = F.array_join(F.transform("copies", lambda c: F.floor(c["position"] * 1e6).cast("string")), ",")  # millionths
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("copies").cast("long").alias("n_copies"), positions.alias("positions"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(quality.mask(quality.POLICIES["base"])).cast("long")) != 0)
    return quality.apply_policy(rows, quality.POLICIES["v2"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    kinds = [count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(secrets.KINDS)]
    tests = F.array_sort(F.transform("tests", lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["encoding"].alias("encoding"), F.floor(t["p"] * 1e4 + 0.5).cast("string").alias("p"))))
    names = F.array(*(F.lit(name) for name, *_ in secrets.KINDS), F.lit("candidate"))
    written = F.array_join(F.transform(tests, lambda t: F.concat_ws(":", F.element_at(names, t["kind"] + 1), t["start"].cast("string"), t["encoding"], t["p"])), ",")  # p in ten-thousandths
    return found.select("doc_id", *kinds, F.sha2(secrets.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"), written.alias("tests"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary(BPE_FILE), bpe_pattern(), digests=True)


#: Words of a stretch that count as repeated: passages over 50 words hold several, stock phrases none.
MIN_WORDS = 16


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.report(table(spark, sf_dir, "documents"), MIN_WORDS)
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_removed", "n_removed_chars", "kept_chars", spans.alias("removed_spans"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(COUNTED_FILE), bpe_pattern())


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which the contract makes every tenth document periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))

    def repeat(w):
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        bounds = F.struct(a.alias("a"), (F.floor((n - a) / (g % 8 + 3)) + 1).alias("p"))
        place = lambda b, i: F.when(i < b["a"], i).otherwise(b["a"] + (i - b["a"]) % b["p"]).cast("int")
        return let(bounds, lambda b: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(b, i))), " "))

    again = F.when((h % 10 == 0) & F.col("text").rlike(WORD), let(words, repeat)).otherwise(F.col("text"))
    return docs.select("doc_id", again.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(looped(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    start, length, period = -F.col("best.back"), F.col("best.length"), -F.col("best.less")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_url_filter": op2_url_filter,
        "op3_neighbours": op3_neighbours,
        "op4_mixing": op4_mixing,
        "op5_html_extraction": op5_html_extraction,
        "op6_quality_rules": op6_quality_rules,
        "op7_simhash": op7_simhash,
        "op8_secret_scan": op8_secret_scan,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_token_counts": op11_token_counts,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_periodic_runs": op13_periodic_runs,
        "quality_ablations": quality_ablations,
    }
