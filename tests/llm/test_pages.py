import pytest

from mailjobs.llm import pages as P

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><h1>A</h1><p>b <b>c</b>d<br>e</article><footer>x</footer>", "A b cd e"),
        ("<nav>m</nav><header>h</header><main><p>x &amp; y&nbsp;z &lt; &#233;</p></main><aside>s</aside>", "x & y z < é"),
        ("<body><div class='cookie-notice'>c</div><div id=main><p>one<p>two<div class=ad>a</div></div><form>f</form>", "one two"),
        ("<article>a<script>var x='</p>';</script><style>p{}</style><!-- c --><section class='comments'><p>r</p></section>b<script>y</script>c</article>", "a bc"),
        ("<p>unclosed <b>bold<p>next", "unclosed bold next"),
        ("plain &amp text", "plain & text"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>", "a b 1 2"),
        ("</div></p>x</article>", "x"),
        (None, ""),
        ("", ""),
        ("<div role=navigation>n</div><div hidden>h</div>t", "t"),
    ],
)
def test_extract(html, text):
    assert P.extract(html) == text


def page(body, note):
    return f"<html><body><div class='x'><p>{note}</p></div><div class='links'><a href='/a{body}'>go {body}</a></div><div class='body'><p>words {body}</p></div></body></html>"


def test_recurring_subtrees_go(spark):
    rows = [(k, f"http://a.com/{k}", page(k, "All about us")) for k in range(20)]
    rows += [(100 + k, f"http://b.com/{k}", page(k, "All about us")) for k in range(3)]  # a host of few pages
    rows += [(400, "http://d.com/", page(1, "All about us"))]  # nothing can recur
    rows += [(200 + k, f"http://c.com/{k}", page(k, f"Note {k}")) for k in range(20)]  # a note of its own
    rows += [(300, None, page(1, "All about us"))]
    got = {r["page_id"]: r["text"] for r in P.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[5] == "words 5"
    assert got[101] == "words 1"
    assert got[400] == "All about us go 1 words 1"
    assert got[207] == "Note 7 words 7"
    assert got[300] == "All about us go 1 words 1"


def test_templates_equal_brute_force(spark, sf):
    from mailjobs.llm.common import url_host
    from pyspark.sql import functions as F

    pages = spark.read.parquet(sf.replace("0.001", "0.01") + "/pages.parquet")
    rows = pages.select(url_host(F.col("url")).alias("host"), "html").collect()
    n, of = {}, {}
    for r in set(rows):
        of[r["host"]] = of.get(r["host"], 0) + 1
        for h, share in P.page_hashes(r["html"]).items():
            n.setdefault((r["host"], h), []).append(share)
    want = {k for k, v in n.items() if len(v) >= max(2, 0.2 * of[k[0]]) and sum(v) / len(v) <= 0.3}
    got = {(r["host"], h & 0xFFFFFFFFFFFFFFFF) for r in P.templates(pages).collect() for h in r["hashes"]}
    assert got == want and want


def test_templates_decide_the_text(spark, sf):
    """Without templates, or with those of another host, no page of a host of several pages comes out right."""
    rows = P.main_text(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert sum(P.extract(r["html"], decided=True) != r["text"] for r in rows) == len(rows)


def test_boxes_whose_words_change_go_by_shape(spark):
    def html(k):
        return f"<body><div class=top><span>Hi {k}</span></div><div class=story><p>{'long story ' * 20}{k}</p><p>more {k}</p></div><div class=low>Note {k} and <a href=/{k}>more</a></div></body>"

    rows = [(k, f"http://a.com/{k}", html(k)) for k in range(4)]
    for r in P.main_text(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r["text"] == f"{'long story ' * 20}{r['page_id']} more {r['page_id']}"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><header><h1>Head</h1></header><div class='notice share related banner'><p>kept</p></div></article>", "Head kept"),
        ("<article><p class=comment-on-law>kept</p><div class=ad-box>a</div><aside>b</aside><form>c</form><section class=comments>d</section></article>", "kept"),
        ("<article><p>x</p></article><div class=comment-list>d</div><div class=other>kept</div>", "x kept"),
    ],
)
def test_markup_inside_an_article(html, text):
    assert P.extract(html, decided=True) == text


def test_paragraphs_of_an_article_are_never_templates():
    for node, inside in P.digest(P.parse("<article><p>The.</p><div class=share><p>x</p></div></article><div><p>y</p></div>")):
        if inside and node.tag == "p":
            assert P.keys(node, inside) == []


def test_articles_of_the_pages(spark, sf):
    import html as H
    import re

    for r in P.main_text(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        m = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r["html"])
        text = re.sub(r"</?b>", "", re.sub(r"</?(?:p|br|h1)[^>]*>", " ", m[1]))
        assert r["text"] == " ".join(H.unescape(text).split()) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, "http://a/", "<p>x</p>")] * 2 + [(None, "http://a/", None), (2, "no host", "<" * 50_000), (3, "", "<div>" * 5000 + "deep"), (4, None, "<p>" + "w " * 200_000), (5, "http://a/", "")]
    pages = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("host", "hash", "hashes", "page", "share", "decided", "of_host", "text", "n_chars")})
    got = sorted(((r["page_id"] or 0, r["text"]) for r in P.main_text(pages).collect()))
    assert got == [(0, ""), (1, "x"), (1, "x"), (2, "<" * 50_000), (3, "deep"), (4, " ".join(["w"] * 200_000)), (5, "")]
    assert P.main_text(pages.where("false")).count() == 0


def test_copies_of_a_page_are_one_page(spark):
    copied = "<html><body><div class='wrap'><div class='body'><p>the whole story</p></div></div></body></html>"
    rows = [(k, "http://a.com/x", copied) for k in range(30)]  # nothing but copies
    rows += [(100 + k, f"http://b.com/{k % 12}", copied) for k in range(30)]
    rows += [(200 + k, f"http://b.com/own/{k}", page(k, "All about us")) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in P.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3] == got[103] == "the whole story"
    assert got[205] == "words 5"  # found on 12 of the host's 13 pages, though on 12 of its 42 rows


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>t</title><body><article><p>a</p></article></body></html>", "a"),
        ("<head><meta charset=utf-8><title>t</title><div>a</div>", "a"),
        ("<head><title>t</title><script>x</script>\n a <b>b</b>", "a b"),
        ("<head><link rel=x><img src=y/>a", "a"),
        ("<head><title>t</title><img src=y />a</head>b", "ab"),
        ("<head><noscript><style>x</style><body>a", "a"),
        ("<head><style>x</style>\n<title>t</title>\n</head><body>a", "a"),
    ],
)
def test_a_head_ends_without_its_end_tag(html, text):
    assert P.extract(html) == text


def texts(spark, pages):
    rows = [(k, f"http://a.com/{k}", html) for k, html in enumerate(pages)]
    return [r["text"] for r in P.main_text(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()]


STORY = "a story that two pages tell in the very same words with one more line"


def test_a_story_shared_by_two_articles_stays(spark):
    html = lambda head, story: f"<body><nav>menu here</nav><article><h1>{head}</h1><div class=body><p>{story}</p></div></article></body>"
    got = texts(spark, [html("One", STORY), html("Two", STORY), html("Three", "another story altogether")])
    assert got == [f"One {STORY}", f"Two {STORY}", "Three another story altogether"]


def test_a_story_shared_by_two_pages_without_an_article_stays(spark):
    def html(k, story):
        return f"<body><div class=nav><a href=/>home</a></div><div class=body><h1>Head {k}</h1><p>{story}</p><p>and the end of {story}</p></div></body>"

    got = texts(spark, [html(k, STORY if k < 2 else f"the story number {k} which no other page of this host tells") for k in range(8)])
    assert got[:2] == [f"Head {k} {STORY} and the end of {STORY}" for k in range(2)]
    assert all("home" not in x and f"number {k}" in x for k, x in enumerate(got[2:], 2))


def test_a_lead_with_other_words_on_each_page_stays(spark):
    def html(k):
        return f"<body><div class=nav><a href=/>home</a></div><div class=lead><p>lead of page {k} in more than eight words or so</p></div><div class=rest><p>{f'the rest of page {k} at some length ' * 8}</p></div></body>"

    for k, text in enumerate(texts(spark, [html(k) for k in range(5)])):
        assert text == f"lead of page {k} in more than eight words or so " + " ".join([f"the rest of page {k} at some length"] * 8)


def test_boxes_of_few_pages_still_go(spark):
    """A box on a quarter of the pages holds little of each, so it is a template."""
    def html(k):
        box = "<div class=box><p>A box of this section only</p></div>" if k < 3 else ""
        return f"<body><article><h1>Head {k}</h1><p>{f'story {k} is long enough ' * 9}</p>{box}</article></body>"

    got = texts(spark, [html(k) for k in range(12)])
    assert not any("A box" in x for x in got) and all(f"story {k} is" in x for k, x in enumerate(got))
