"""Fixed inputs and their expected results."""

import pytest
from pyspark.sql import functions as F

from mailjobs.functions import html as H
from mailjobs.functions import text as X
from mailjobs.operators.chunks import chunk_array

CASES = [
    (X.replace_images, '<img width="9" src="a/b.gif" alt="a red boat">', "[An image of a red boat]"),
    (X.replace_images, "<img alt='north'>|<img alt='south'/>", "[An image of north]|[An image of south]"),
    (X.replace_links, "two: http://x-1.net https://y.co.uk/z?q=%20 end", "two: [LINK] [LINK] end"),
    (X.replace_links, "https://www.ships.example/list#top", "[LINK]"),
    (X.replace_links, "Look (https://a.com/x here", "Look [LINK] here"),
    (X.strip_formatting, "one\t\t\ttwo\n\r\nthree\rfour   five", "one two\nthree\nfour five"),
    (X.strip_formatting, "left =====  right", "left right"),
    (X.strip_non_words, "sum 0f1e2d3c4b5a69788796a5b4c3d2e1f0 ok", "sum  ok"),
    (X.strip_non_words, "row 01234567-89ab-cdef-0123-456789abcdef!", "row !"),
    (X.strip_non_words, "key " + "Qz9/" * 12 + "== end", "key  end"),
    (X.strip_non_words, "parcel " + "zz-9_" * 6 + "q today", "parcel  today"),
    (X.strip_non_words, "seat 17B, flight LH400, gate #9", "seat 17B, flight LH400, gate #9"),
    (X.strip_non_text, "a\x01b\x7fc\x08", "abc"),
    (X.strip_non_text, "Grüße, señor 😀☀", "Grüße, señor 😀☀"),
    (X.strip_non_text, "© sign", " sign"),
    (X.strip_footer, "The boat leaves at nine. Opt-out with one click.", "The boat leaves at nine."),
    (X.strip_footer, "Bring bread.\n\nSent from my iPad", "Bring bread."),
    (X.strip_footer, "No ending at all, see you.  ", "No ending at all, see you.  "),
    (X.html_escape, 'a & b, "quoted" <x>', "a &amp; b, &quot;quoted&quot; &lt;x&gt;"),
    (X.sanitize_css, '@import url("x.css"); p { background: url( \'a\' ); }', " p { background: ; }"),
    (X.extract_head, "<html><HEAD a='1'>x\ny</head>", "x\ny"),
    (X.extract_body, "no body", None),
    (X.estimate_tokens, "äöü12", 2),
    (H.sanitize_html, '<p onclick="x()">a<script>b</script><a href="javascript:x">c</a><!-- d --></p>', "<p>a<a>c</a></p>"),
    (H.sanitize_html, '<style>@import "x"; p{color:red}</style><img src="cid:1" onerror="x">', '<style> p{color:red}</style><img src="cid:1">'),
    (H.html_to_text, "<h1>Hi</h1><p>a <a href='x'>link</a> &amp; b</p><script>x</script>", "Hi\na link & b"),
]


@pytest.mark.parametrize(("f", "given", "expected"), CASES)
def test_functions(one, f, given, expected):
    assert one(f(F.lit(given))) == expected


def test_divider_pass_alone(one):
    for mark in ("---", "===", "___"):
        assert one(F.regexp_replace(F.lit(f"x {mark} y"), X.DIVIDERS, " ")) == "x   y"


def test_null_stays_null(one):
    for f in (X.simplify_text, X.strip_footer, X.html_escape, H.sanitize_html, H.html_to_text, X.parse_custom_id):
        assert one(f(F.lit(None).cast("string"))) is None


def test_render_nulls(one):
    none = F.lit(None).cast("string")
    assert one(X.render_message(none, none)) == "<subject></subject> <body></body>"


def test_custom_ids(one):
    made = X.make_custom_id(F.lit(7), F.lit("a_b_9"))
    assert one(made) == "7_a_b_9"
    assert tuple(one(X.parse_custom_id(made))) == (7, "a_b_9")
    for bad in ("plain", "x_7", ""):
        assert one(X.parse_custom_id(F.lit(bad))) is None


CHUNKS = [
    ("Boats sail. Do they sink? Never!", ["Boats sail.", "Do they sink?", "Never!"]),
    ("", []),
    ("   ", []),
    ("a" * 32_868, ["a" * 32_768]),
    ("North.  . South.", ["North.", "South."]),
    ("left shore[LINK]then the pier[LINK]home", ["left shore", "then the pier", "home"]),
    ("Anchor. 77. %&/. 1999-12-31. Set the sails.", ["Anchor.", "Set the sails."]),
    ("Keel. X. Y 2 Z. Mast.", ["Keel.", "Mast."]),
]


@pytest.mark.parametrize(("given", "expected"), CHUNKS)
def test_chunks(one, given, expected):
    assert one(chunk_array(F.lit(given))) == expected


def test_header_and_body(one):
    headers = F.array(F.struct(F.lit("SUBJECT").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("subject").alias("name"), F.lit("y").alias("value")))
    assert one(X.header_value(headers, "Subject")) == "x"
    assert one(X.header_value(headers, "From")) is None
    assert one(X.pick_body(F.array().cast("array<struct<mime_type:string,data:string>>"), True)) == "<p>No content</p>"


def test_public_vocabulary_counts(spark):
    """Against the same vocabulary in another library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from mailjobs.functions.tokens import count_tokens

    peer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    peer.encode_special_tokens = True
    texts = ["Hello, world!", "", "größer als 3½ 😀\n\n  x", "a" * 5000, "<|endoftext|>"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", count_tokens(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == {None: None, **{t: len(peer.encode(t, add_special_tokens=False).ids) for t in texts}}
    assert rows[0]["n"] == 4


def test_read_jdbc(spark):
    """A table of an embedded database, read in ranges and in several tasks."""
    from mailjobs.sources.tables import read_jdbc

    url = "jdbc:derby:memory:mailjobs_test;create=true"
    rows = spark.range(100).selectExpr("cast(id as int) as id", "cast(id % 7 as int) as user_id")
    rows.write.format("jdbc").options(url=url, dbtable="items", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    got = read_jdbc(spark, url, "items", "ID", (0, 100), 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert got.rdd.getNumPartitions() == 4
    assert sorted((r[0], r[1]) for r in got.collect()) == [(k, k % 7) for k in range(100)]
