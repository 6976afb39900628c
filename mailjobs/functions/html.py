"""HTML for mail: sanitising, readable text, display pages. Arrow batches over a small parser; a message is
parsed once for both its sanitised form and its text."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

# What a sanitised message may hold.
TAGS = frozenset(
    "a abbr acronym address area article aside b bdi bdo big blockquote br caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer h1 h2 h3 h4 h5 h6 header hr i img ins kbd li main map mark meta nav ol p pre q rp rt ruby s samp section small span strike strong style sub summary sup table tbody td tfoot th thead time tr tt u ul var wbr".split()
)
ANYWHERE = frozenset("style class id dir lang title".split())
ATTRIBUTES = {
    "a": "href name target title",
    "img": "src alt title width height",
    "table": "border cellpadding cellspacing width height align bgcolor",
    "td": "colspan rowspan width height align valign bgcolor",
    "th": "colspan rowspan width height align valign bgcolor",
    "tr": "align valign bgcolor",
    "col": "span width",
    "colgroup": "span width",
    "font": "color face size",
    "div": "align",
    "p": "align",
    "area": "alt coords href shape",
    "map": "name",
    "meta": "name content charset",
}
SCHEMES = frozenset("http https mailto cid".split())
VOID = frozenset("area br col hr img meta wbr".split())
BLOCKS = frozenset("address article aside blockquote br center dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
_css = re.compile(X.CSS_IMPORT), re.compile(X.CSS_URL)
_scheme = re.compile(r"^[\x00-\x20]*([a-zA-Z][a-zA-Z0-9+.\-]*)[\x00-\x20]*:")


#: Elements whose text isn't shown.
HIDDEN = frozenset(("script", "style", "head", "title"))
_blanks, _spaces = re.compile(r"\s+"), re.compile(r" +")


class _Clean(HTMLParser):
    """``out``: the sanitised document. ``shown``: the text of that document, images by their description."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.shown: list[str] = []
        self.open: list[str] = []
        self.hidden = 0
        self.skip = ""  # inside script: its content goes too

    def handle_starttag(self, tag, attrs):
        if self.skip or tag == "script":
            self.skip = self.skip or tag
        elif tag in TAGS:
            allowed = ANYWHERE | set(ATTRIBUTES.get(tag, "").split())
            kept = [(k, v or "") for k, v in attrs if k in allowed and not (k in ("href", "src") and unsafe(v or ""))]
            self.out.append(f"<{tag}{''.join(f' {k}="{entities.escape(v)}"' for k, v in kept)}>")
            if tag not in VOID:
                self.open.append(tag)
                self.hidden += tag in HIDDEN
            if tag in BLOCKS:
                self.shown.append("\n")
            if tag == "img" and not self.hidden and (alt := [v for k, v in kept if k == "alt"]):
                self.shown.append(_blanks.sub(" ", f"[An image of {alt[-1]}]"))

    def handle_endtag(self, tag):
        if self.skip:
            self.skip = "" if tag == self.skip else self.skip
        elif tag in self.open:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                self.hidden -= last in HIDDEN
                if last in BLOCKS:
                    self.shown.append("\n")
                if last == tag:
                    break

    def handle_data(self, data):
        if self.skip:
            return
        if self.open and self.open[-1] == "style":
            for pattern in _css:
                data = pattern.sub("", data)
            self.out.append(data)
        else:
            self.out.append(entities.escape(data, quote=False))
        if not self.hidden:
            self.shown.append(_blanks.sub(" ", data))


def unsafe(url: str) -> bool:
    found = _scheme.match(url)
    return bool(found) and found[1].lower() not in SCHEMES


def lines(shown: list[str]) -> str:
    """Pieces of text as lines without outer blanks and empty ones."""
    found = (_spaces.sub(" ", line).strip() for line in "".join(shown).split("\n"))
    return "\n".join(line for line in found if line)


def parse(html: str) -> tuple[str, str]:
    """The sanitised document and its text."""
    parser = _Clean()
    parser.feed(html)
    parser.close()
    return "".join(parser.out) + "".join(f"</{t}>" for t in reversed(parser.open)), lines(parser.shown)


def clean(html: str) -> str:
    return parse(html)[0]


class _Read(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(_blanks.sub(" ", data))


def read(html: str) -> str:
    parser = _Read()
    parser.feed(html)
    parser.close()
    return lines(parser.out)


#: Messages that a worker parses before it hands their results on.
ROWS = 256


def _mapped(f):
    """A column function of ``f``. Results leave in short batches, so that a worker never holds those of
    a whole Arrow batch of messages, nor these as Python strings."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                yield pa.array([None if t is None else f(t) for t in batch.slice(k, ROWS).to_pylist()], pa.string())

    return run


def _mapped_both(f, returns: str, of: pa.DataType):
    """As ``_mapped``, for a function of two columns: both go through one worker."""

    @F.arrow_udf(returns)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for first, second in batches:
            for k in range(0, len(first), ROWS):
                yield pa.array(map(f, first.slice(k, ROWS).to_pylist(), second.slice(k, ROWS).to_pylist()), of)

    return run


def sanitize_html(c: Column) -> Column:
    """Only listed tags, attributes and URL schemes; comments and scripts go, style blocks are kept
    without imports and url()."""
    return _mapped(clean)(c)


def html_to_text(c: Column) -> Column:
    """Readable text: link text stays, blocks begin on new lines."""
    return _mapped(read)(c)


def parse_message(c: Column) -> Column:
    """struct(clean, text): the sanitised form and its text, from one parse. Null for null."""

    of = pa.struct([pa.field("clean", pa.string()), pa.field("text", pa.string())])

    @F.arrow_udf("clean string, text string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                yield pa.array([(None, None) if t is None else parse(t) for t in batch.slice(k, ROWS).to_pylist()], of)

    return run(c)


def simplify_mail(df: DataFrame, subject: str = "subject", body: str = "body") -> DataFrame:
    """Cleans both columns: HTML becomes text, links and tokens go, footers are cut."""
    both = _mapped_both(lambda s, b: (None if s is None else read(s), None if b is None else parse(b)[1]), "subject string, body string", pa.struct([("subject", pa.string()), ("body", pa.string())]))
    rows = df.withColumn("__read", both(F.col(subject), F.col(body)))
    return rows.withColumns({body: X.tidy_body(F.col("__read.body")), subject: X.tidy_subject(F.col("__read.subject"))}).drop("__read")


# Fixed value: the shell that display pages are put in.
SHELL_START = """<!DOCTYPE html>
<html>
<head>
    <meta name="viewport" content="width=device-width, initial-scale=1.0, maximum-scale=1.0">
    <style>
        * { box-sizing: border-box !important; }
        html, body { margin: 0 !important; padding: 0 !important; width: 100% !important; }
        body { overflow-x: hidden !important; }
        img { max-width: 100% !important; height: auto !important; }
    </style>
"""


def style_blocks(html: str) -> str:
    """Cleans what stands in <style> elements."""
    return re.sub(r"(?is)(<style[^>]*>)(.*?)(</style>)", lambda m: m[1] + _css[1].sub("", _css[0].sub("", m[2])) + m[3], html)


def display_html(html: Column) -> Column:
    """A page to show: the original head with cleaned styles, and the sanitised body."""
    return _mapped_both(_page, "string", pa.string())(X.extract_head(html), F.coalesce(X.extract_body(html), html))


def _page(head: str | None, body: str | None) -> str | None:
    return None if body is None else f"{SHELL_START}{style_blocks(head or '')}\n</head>\n<body>{clean(body)}</body>\n</html>"
