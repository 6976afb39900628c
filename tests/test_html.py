"""Sanitising and reading against a walk over the trees that markup was made from, and the one parse against
two."""

import html as entities
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailjobs.functions import html as H
from mailjobs.functions import text as X
from mailjobs.operators import chunks as K

WORDS = st.text(alphabet="ab <>&\"'é\n", max_size=12)
GOOD, BAD = {"class": "c", "title": "a'b\"<"}, {"onclick": "x()", "data-x": "1"}


def trees(depth):
    text = WORDS.map(lambda t: ("text", t))
    leaf = st.one_of(text, st.just(("br", {}, None)), WORDS.map(lambda t: ("img", {"alt": t, "onerror": "x"}, None)), st.just(("script", {}, "x<y")), st.just(("note", "c")))
    if not depth:
        return leaf
    tag = st.sampled_from(["p", "div", "b", "span", "td", "form", "title"])
    return st.one_of(leaf, st.tuples(tag, st.sampled_from([{}, GOOD, BAD, GOOD | BAD]), st.lists(trees(depth - 1), max_size=4)))


def source(node):
    if node[0] == "text":
        return entities.escape(node[1])
    if node[0] == "note":
        return f"<!-- {node[1]} -->"
    tag, attrs, inner = node
    start = f"<{tag}{''.join(f' {k}=\"{entities.escape(v)}\"' for k, v in attrs.items())}>"
    if inner is None:
        return start
    return f"{start}{inner if tag == 'script' else ''.join(map(source, inner))}</{tag}>"


def walked(node):
    """Sanitised markup and text of a tree."""
    if node[0] == "text":
        return entities.escape(node[1], quote=False), re.sub(r"\s+", " ", node[1])
    if node[0] in ("note", "script"):
        return "", ""
    tag, attrs, inner = node
    parts = [walked(x) for x in inner or ()]
    markup, text = "".join(p[0] for p in parts), "".join(p[1] for p in parts)
    if tag not in H.TAGS:
        return markup, text
    kept = "".join(f' {k}="{entities.escape(v)}"' for k, v in attrs.items() if k in ("class", "title") or (tag, k) == ("img", "alt"))
    if tag == "img":
        text = re.sub(r"\s+", " ", f"[An image of {attrs['alt']}]")
    edge = "\n" if tag in H.BLOCKS else ""
    return f"<{tag}{kept}>{markup}" + (f"</{tag}>" if inner is not None else ""), edge + text + (edge if inner is not None else "")


@settings(max_examples=400, deadline=None)
@given(st.lists(trees(3), max_size=4))
def test_trees(nodes):
    # No title inside: browsers and the parser take its content as text.
    markup = "".join(map(source, nodes))
    if "<title" in markup:
        return
    want = [walked(n) for n in nodes]
    clean, text = H.parse(markup)
    assert clean == "".join(w[0] for w in want)
    lines = [re.sub(" +", " ", line).strip() for line in "".join(w[1] for w in want).split("\n")]
    assert text == "\n".join(line for line in lines if line)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='a'>", "</div>", "<br/>", "<img alt=\"x 'y' &gt;\">", "<img src=q>", "<style>p{} <b></style>", "<script>", "</script>", "<head>", "</head>", "a < b", "&lt;p&gt;", "&nbsp;", "text ", "\n", "<b", ">", "<!-- -->", "<table><tr><td>", "</table>", "\"", "&amp;lt;"]), max_size=14).map("".join))
def test_one_parse_equals_two(markup):
    clean, text = H.parse(markup)
    shown = re.sub(X.IMAGE, r"[An image of \1]", clean)
    assert text == H.read(shown)
    assert H.parse(clean)[0] == clean  # sanitising again changes nothing


def test_columns(spark):
    rows = spark.createDataFrame([(1, "<p onclick='x'>a<img alt='b'></p>c"), (2, None), (3, "")], "id int, t string")
    got = {r["id"]: r["m"] for r in rows.select("id", H.parse_message(F.col("t")).alias("m")).collect()}
    assert tuple(got[1]) == ('<p>a<img alt="b"></p>c', "a[An image of b]\nc") and tuple(got[3]) == ("", "")
    assert got[2] is None or tuple(got[2]) == (None, None)


@pytest.mark.parametrize("text", ["", "abcdef", "éééééé", "a😀b😀", "漢字仮名", "\ufffdé\ufffd"])
@pytest.mark.parametrize("n", range(1, 14))
def test_first_bytes(one, text, n):
    want = text.encode()[:n].decode("utf-8", "ignore")
    assert one(K.first_bytes(F.lit(text), n)) == want


def test_results_leave_in_short_batches(spark):
    """A worker hands results on before it has parsed a whole Arrow batch; nulls, order and rows stay."""
    page = "<html><head><style>@import 'x';p{}</style></head><body><p onclick='x'>%d</p></body></html>"
    rows = spark.range(1000, numPartitions=1).select("id", F.when(F.col("id") % 7 > 0, F.format_string(page, "id")).alias("t"))
    for f in (H.sanitize_html, H.html_to_text, H.display_html, H.parse_message):
        got = rows.select("id", f(F.col("t")).alias("out")).orderBy("id").collect()
        assert [r["id"] for r in got] == list(range(1000))
        for r in got:
            text = str(r["out"])
            assert f">{r['id']}<" in text or f"'{r['id']}'" in text or text == str(r["id"]) if r["id"] % 7 else r["out"] is None or tuple(r["out"]) == (None, None)
    mail = H.simplify_mail(rows.select("id", F.col("t").alias("subject"), F.col("t").alias("body"))).orderBy("id").collect()
    assert [(r["id"], r["subject"], r["body"]) for r in mail[:2]] == [(0, None, None), (1, "1", "1")] and mail[0].__fields__ == ["id", "subject", "body"]
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (rows.select(H.display_html(F.col("t"))), H.simplify_mail(rows.select(F.col("t").alias("subject"), F.col("t").alias("body"))))]
    assert [p.count("ArrowEvalPython [") for p in plans] == [1, 1] and all("run(" in p for p in plans)
    sizes = []
    sent = [pa.array(["<b>x</b>"] * 1000)]
    for part in H._mapped(H.clean).func(iter(sent)):
        sizes.append(len(part))
    assert sum(sizes) == 1000 and max(sizes) <= H.ROWS
