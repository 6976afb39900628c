"""URL filtering by rules and by trust that spreads over the host graph, in DataFrame operations only.

A rule names a host (it fits the host and all subdomains) and the beginning of a path; the longest
fitting rule decides. Urls without a rule are decided by their host's trust: personalised PageRank
from trusted hosts along links, against the same from blocked hosts along reversed links (a host that
links to blocked ones is suspect). A host is blocked if its share of distrust passes the threshold.

Host edges come from the absolute links of the pages, counted by (host, host) before anything is
joined. Trusted seeds weigh by the share of their pages that rules allow, blocked seeds by the share
that whole-host rules block. Rank that runs into hosts without links is dropped; returning it to the
seeds would only scale all ranks of a kind alike.

Defined results: a null url or one without :// has an empty host and path, no rule, and is allowed;
of fitting rules of equal length the first by code point wins; without links or seeds nothing is
distrusted and the method allows; repeated rows give repeated rows; other columns take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, url_host, url_path

ALLOW, BLOCK = "allow", "block"
#: So many rules are matched inside one expression; longer lists are joined by host suffix.
INLINE_RULES = 500
#: Up to so many hosts with a say (some MB) they are broadcast to the pages; beyond it Spark joins by host.
BROADCAST_HOSTS = 100_000
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def _rule(host: Column, path: Column, text: str, verdict: str) -> Column:
    of_host, slash, rest = text.partition("/")
    fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + rest)
    return F.when(fits, F.struct(F.lit(-len(text)).alias("order"), F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(slash + rest in ("", "/")).alias("whole")))


def match_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds rule, verdict (of the rule) and whole (the rule covers its whole host) to rows of host and
    path; null where none fits. ``rules`` are pairs such as ("net/", "block")."""
    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string"), "whole": F.lit(False)})
    if len(rules) <= INLINE_RULES:
        fits = F.array_compact(F.array(*(_rule(F.col("host"), F.col("path"), *r) for r in rules)))
        best = urls.withColumn("__best", F.array_min(fits))
        return best.select(*urls.columns, F.col("__best.rule").alias("rule"), F.col("__best.verdict").alias("verdict"), F.coalesce(F.col("__best.whole"), F.lit(False)).alias("whole"))
    spark = urls.sparkSession
    listed = spark.createDataFrame(rules, "rule string, verdict string")
    start = F.instr("rule", "/")
    listed = listed.withColumn("of_host", F.when(start > 0, F.substring("rule", F.lit(1), start - 1)).otherwise(F.col("rule")))
    listed = listed.withColumn("begins", F.substring("rule", F.length("of_host") + 1, F.length("rule")))
    # Distinct (host, path) pairs, each with its host's suffixes, meet the rules by equal suffix.
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    distinct = checkpointed(urls.select("host", "path").distinct())
    order = F.struct((-F.length("rule")).alias("order"), "rule", "verdict", F.col("begins").isin("", "/").alias("whole"))
    best = distinct.withColumn("of_host", F.explode(suffixes)).join(listed, "of_host").where(F.expr("startswith(path, begins)")).groupBy("host", "path").agg(F.min(order).alias("b"))
    found = checkpointed(best.select(F.col("host").alias("__h"), F.col("path").alias("__p"), "b"))
    joined = urls.join(found, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left")
    return joined.select(*(urls[c] for c in urls.columns), F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict"), F.coalesce(F.col("b.whole"), F.lit(False)).alias("whole"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages of one host to another host, counted."""
    links = pages.select(url_host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    return links.select("src", url_host(to).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, every: int = 6, tolerance: float = 1e-6) -> DataFrame:
    """host, trust, distrust. ``edges`` are (src, dst, n), ``seeds`` (host, trust, distrust) with
    weights. Both kinds of rank move in one join and one aggregation a round, until less than
    ``tolerance`` of the rank is on its way: k rounds leave damping ** k of it at most."""
    edges = checkpointed(edges)
    total = seeds.agg(F.sum("trust"), F.sum("distrust")).first()
    kinds = [("trust", total[0] or 0.0), ("distrust", total[1] or 0.0)]
    start = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), (F.col(k) / F.lit(t) if t else F.lit(0.0)).alias("seed")) for k, t in kinds)))
    first = checkpointed(seeds.select("host", start.alias("s")).select("s.kind", "host", "s.seed").where("seed > 0"))
    rank = first.select("kind", "host", (F.col("seed") * (1 - damping)).alias("r"))
    if not edges.isEmpty():
        out = edges.groupBy("src").agg(F.sum("n").alias("t"))
        into = edges.groupBy("dst").agg(F.sum("n").alias("t"))
        forth = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("next"), (F.col("n") / F.col("t")).alias("w"))
        back = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("next"), (F.col("n") / F.col("t")).alias("w"))
        steps = checkpointed(forth.unionByName(back))
        base = rank
        before = 0.0
        for k in range(1, math.ceil(math.log(tolerance) / math.log(damping)) + 1):
            moved = steps.join(rank, ["kind", "host"]).select("kind", F.col("next").alias("host"), (F.lit(damping) * F.col("w") * F.col("r")).alias("r"))
            rank = moved.unionByName(base).groupBy("kind", "host").agg(F.sum("r").alias("r"))
            if k % every == 0:
                rank = checkpointed(rank)
                now = rank.agg(F.sum("r")).first()[0] or 0.0
                if now - before <= tolerance:
                    break
                before = now
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("r"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(part("trust"), part("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.5, damping: float = 0.85) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every row of ``pages``."""
    urls = pages.select("page_id", url_host(F.coalesce("url", F.lit(""))).alias("host"), url_path(F.coalesce("url", F.lit(""))).alias("path"))
    matched = match_rules(urls, rules)
    seeds = matched.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("verdict") == ALLOW, F.lit(1.0)).otherwise(F.lit(0.0))).alias("trust"),
        F.avg(F.when((F.col("verdict") == BLOCK) & F.col("whole"), F.lit(1.0)).otherwise(F.lit(0.0))).alias("distrust"),
    )
    ranks = checkpointed(propagate(host_edges(pages), seeds, damping)).withColumnRenamed("host", "of_host")
    if ranks.count() <= BROADCAST_HOSTS:
        ranks = F.broadcast(ranks)
    rows = matched.join(ranks, F.col("host") == F.col("of_host"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when((distrust > 0) & (distrust >= threshold * (trust + distrust)), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
