import pytest

from mailjobs.llm import urls as U
from mailjobs.llm.common import url_host, url_path
from mailjobs.llm.queries import RULES
from pyspark.sql import functions as F

URLS = ["http://A.b.Net/x", "https://example.net/en/1?q#r", "http://sub.example.net/en/", "http://example.com/de/1", "http://example.com/en/1", "http://x.org/fr/1", "http://net", "no scheme/x", "", None, "http://h?x=://y/z", "http://notexample.com/de/1", "ftp://e.net#/x", "http://é.ORG/fr/é"]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host, path[:end]


def verdict(host, path, rules):
    best = None
    for rule, v in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, v)
    return best


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_hosts_and_rules(spark):
    pages = pages_of(spark, [(k, u, None) for k, u in enumerate(URLS)] + [(0, URLS[0], None)])
    got = U.judge(pages, RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = plain(URLS[r["page_id"]])
        best = verdict(host, path, RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == (best[1] if best else "allow")


def test_many_rules_are_joined_with_the_same_result(spark, monkeypatch):
    pages = pages_of(spark, [(k, u, None) for k, u in enumerate(URLS)])
    rules = RULES + [("b.net/x", "allow"), ("example.com", "block"), ("org/fr/", "block")]
    key = lambda d: sorted((r["page_id"], r["rule"], r["verdict"]) for r in d.collect())
    inline = key(U.judge(pages, rules[:-1]))
    monkeypatch.setattr(U, "INLINE_RULES", 0)
    assert key(U.judge(pages, rules[:-1])) == inline


def pagerank(edges, seeds, d=0.85, rounds=400):
    total = sum(seeds.values()) or 1
    base = {h: (1 - d) * v / total for h, v in seeds.items()}
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    rank = dict(base)
    for _ in range(rounds):
        new = dict(base)
        for (a, b), n in edges.items():
            if a in rank:
                new[b] = new.get(b, 0) + d * rank[a] * n / out[a]
        rank = new
    return rank


def test_propagation_equals_brute_force(spark):
    edges = {("a", "b"): 2, ("a", "c"): 1, ("b", "a"): 1, ("c", "bad"): 3, ("d", "bad"): 1, ("bad", "d"): 1}
    trust, bad = {"a": 1.0}, {"bad": 0.5}
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("bad", 0.0, 0.5)], "host string, trust double, distrust double")
    rows = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    got = {r["host"]: r for r in U.propagate(rows, seeds, tolerance=1e-9).collect()}
    want_t, want_d = pagerank(edges, trust), pagerank({(b, a): n for (a, b), n in edges.items()}, bad)
    for h in got:
        assert got[h]["trust"] == pytest.approx(want_t.get(h, 0), abs=1e-8) and got[h]["distrust"] == pytest.approx(want_d.get(h, 0), abs=1e-8)


def test_rank_on_a_cycle_is_spread_to_the_tolerance(spark):
    """On a cycle a third of the rank is under way for long; its ranks are known in closed form."""
    rows = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double")
    got = {r["host"]: r["trust"] for r in U.propagate(rows, seeds).collect()}
    a = 0.15 / (1 - 0.85**3)
    assert [got[h] for h in "abc"] == pytest.approx([a, 0.85 * a, 0.85**2 * a], abs=1e-6)


def test_odd_rows(spark):
    """Nulls, repeated rows, a very long page and extra columns whose names clash."""
    html = "<a href='http://spam.net/'>" + "w " * 200_000 + "<a href=http://spam.net/9>"
    rows = [(1, "http://suspect.com/1", html)] * 2 + [(None, None, None), (2, "http://spam.net/", "")]
    names = ("host", "path", "rule", "verdict", "trust", "distrust", "of_host", "src", "dst", "n", "kind", "whole")
    pages = pages_of(spark, rows).withColumns({c: F.lit("clash") for c in names})
    got = sorted((r["page_id"] or 0, r["host"], r["verdict"]) for r in U.judge(pages, RULES).collect())
    assert got == [(0, "", "allow"), (1, "suspect.com", "block"), (1, "suspect.com", "block"), (2, "spam.net", "block")]


def test_a_host_that_links_to_blocked_ones_is_blocked(spark):
    html = '<a href="http://spam.net/">x</a> <a class=q href=\'//spam.net/2\'>y</a> <a href="/own">z</a>'
    pages = pages_of(spark, [(1, "http://suspect.com/1", html), (2, "http://clean.com/1", '<a href="http://other.com/">o</a>'), (3, "http://spam.net/", None)])
    got = {r["page_id"]: r["verdict"] for r in U.judge(pages, RULES).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"}


def test_empty_and_no_rules(spark):
    assert U.judge(pages_of(spark, []), RULES).count() == 0
    assert {r["verdict"] for r in U.judge(pages_of(spark, [(1, "http://a.net/", None)]), []).collect()} == {"allow"}


def test_native(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    plan = U.judge(pages, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = pages.select("url", url_host(F.col("url")).alias("h"), url_path(F.col("url")).alias("p")).collect()
    assert all((r["h"], r["p"]) == plain(r["url"]) for r in rows)


def test_links_and_sql_agree(spark, tmp_path):
    """The registered query against DuckDB on pages that do link to each other."""
    from mailjobs.llm import oracles, queries
    from tests.helpers import rows_of

    link = lambda *hosts: "".join(f'<A HREF="http://{h}/x">l</A>' for h in hosts)
    rows = [(1, "http://a.example.com/en/1", link("b.example.com", "s.example.net")), (2, "http://b.example.com/en/1", link("c.example.com")), (3, "http://c.example.com/1", link("s.example.net", "s.example.net")), (4, "http://s.example.net/1", link("a.example.com")), (5, "http://d.example.org/fr/1", link("b.example.com")), (6, "http://b.example.com/de/1", None), (7, None, link("s.example.net"))]
    pages_of(spark, rows).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    df = queries.op2_url_filter(spark, str(tmp_path))
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    sql = oracles.oracle_sql()["op2_url_filter"]
    got = rows_of((df.columns, [tuple(r) for r in df.collect()]))
    want = rows_of((con.sql(sql).columns, con.execute(sql).fetchall()))
    assert got == want
