"""Queries of text cleaning, chunking, prompts and HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..functions.tokens import count_tokens
from ..operators import chunks as K
from .registry import query

#: Literal text around each document, since the documents have few links, tokens and footers.
DECORATED = "concat('Visit (https://www.example.com/a/b?x=', doc_id, ') now\t\tplease ', '© — ', text, ' --- ', md5(cast(doc_id as string)), ' 550e8400-e29b-41d4-a716-446655440000 end.', case when doc_id % 3 = 0 then ' Click here to unsubscribe from this list' else '' end)"
DECORATED_SQL = "concat('Visit (https://www.example.com/a/b?x=', doc_id, ') now', chr(9), chr(9), 'please ', '© — ', text, ' --- ', md5(cast(doc_id as varchar)), ' 550e8400-e29b-41d4-a716-446655440000 end.', case when doc_id % 3 = 0 then ' Click here to unsubscribe from this list' else '' end)"

_LINK = r"https?://(www\.)?[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_+.~#?&/=]*)"
_EMOJI = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF), (0x1F900, 0x1F9FF), (0x1FA00, 0x1FA6F), (0x2600, 0x26FF), (0x2700, 0x27BF), (0x1F100, 0x1F1FF)))


def links_sql(c: str) -> str:
    return f"replace(regexp_replace({c}, '{_LINK}', '[LINK]', 'g'), '([LINK]', '[LINK]')"


def non_words_sql(c: str) -> str:
    for p in (r"\b[a-fA-F0-9]{32,}\b", r"\b[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}\b", r"[a-zA-Z0-9+/]{40,}={0,2}", r"\b[a-zA-Z0-9_-]{30,}\b"):
        c = f"regexp_replace({c}, '{p}', '', 'g')"
    return c


def non_text_sql(c: str) -> str:
    return rf"regexp_replace({c}, '[^\p{{L}}\p{{M}}\p{{N}}\s!-/:-@\[-`{{-~{_EMOJI}]', '', 'g')"


def formatting_sql(c: str) -> str:
    for p, r in ((r"[\t]+", "' '"), (r"[\n\r]+", "chr(10)"), (r"[-=_*]{3,}", "' '"), (r" {2,}", "' '")):
        c = f"regexp_replace({c}, '{p}', {r}, 'g')"
    return c


def footer_sql(c: str) -> str:
    p = X.FOOTER.replace("(?iU)", "(?i)").replace("'", "''")
    return f"case when regexp_matches({c}, '{p}') then regexp_replace(regexp_extract({c}, '(?s)^(.*?)(?:{p})', 1), '\\s+$', '') else {c} end"


CLEAN_SQL = formatting_sql(non_text_sql(non_words_sql(links_sql("t"))))
_DOCS = f"select doc_id, {DECORATED_SQL} as t from documents"


def _docs(t):
    return t("documents").select("doc_id", F.expr(DECORATED).alias("t"))


def _text(name: str, f, sql: str):
    query(name, f"select doc_id, {sql} as out from ({_DOCS})")(lambda t: _docs(t).select("doc_id", f(F.col("t")).alias("out")))


_text("b1_replace_links", X.replace_links, links_sql("t"))
_text("b2_strip_non_words", X.strip_non_words, non_words_sql("t"))
_text("b3_strip_non_text", X.strip_non_text, non_text_sql("t"))
_text("b4_strip_formatting", X.strip_formatting, formatting_sql("t"))
_text("b5_strip_footer", X.strip_footer, footer_sql("t"))
_text("b7_simplify_text", X.simplify_text, CLEAN_SQL)
_text("b17_html_escape", X.html_escape, "replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')")
_text("b20_estimate_tokens", X.estimate_tokens, "octet_length(encode(t)) // 4")

_IMG = "'<p>' || url || '</p><img src=\"a.png\" alt=\"page ' || page_id || '\"/>' || html"


@query("b6_replace_images", f"""select page_id, regexp_replace({_IMG}, '<img[^>]*alt=["'']([^"'']*)["''][^>]*/?>', '[An image of \\1]', 'g') as out from pages""")
def _(t):
    return t("pages").select("page_id", X.replace_images(F.expr(_IMG)).alias("out"))


@query("b9_render_message", "select email_id, '<subject>' || coalesce(subject, '') || '</subject> <body>' || coalesce(body, '') || '</body>' as out from m_item")
def _(t):
    return t("m_item").select("email_id", X.render_message(F.col("subject"), F.col("body")).alias("out"))


@query("b8_simplify_mail")
def _(t):
    return H.simplify_mail(t("pages").select("page_id", F.col("url").alias("subject"), F.col("html").alias("body")))


@query("b10_sanitize_html")
def _(t):
    return t("pages").select("page_id", H.sanitize_html(F.col("html")).alias("out"))


_CSS = "'@import url(x.css); p{background:URL( \"a.png\" );margin:' || page_id || 'px}' || html"


@query("b11_sanitize_css", rf"""select page_id, regexp_replace(regexp_replace({_CSS}, '(?i)@import\s+(?:url\s*\([^)]*\)|[''"][^''"]*[''"])[^;]*;', '', 'g'), '(?i)url\s*\(\s*(?:"[^"]*"|''[^'']*''|[^)]*)\s*\)', '', 'g') as out from pages""")
def _(t):
    return t("pages").select("page_id", X.sanitize_css(F.expr(_CSS)).alias("out"))


@query("b12_html_to_text")
def _(t):
    return t("pages").select("page_id", H.html_to_text(F.col("html")).alias("out"))


@query("b13_head_and_body", "select page_id, case when regexp_matches(html, '(?is)<head[^>]*>(.*?)</head>') then regexp_extract(html, '(?is)<head[^>]*>(.*?)</head>', 1) end as head, case when regexp_matches(html, '(?is)<body[^>]*>(.*?)</body>') then regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) end as body from pages")
def _(t):
    return t("pages").select("page_id", X.extract_head(F.col("html")).alias("head"), X.extract_body(F.col("html")).alias("body"))


@query("b14_header_value", "select page_id, case when page_id % 4 > 0 then url end as out from pages")
def _(t):
    name = F.when(F.col("page_id") % 4 == 0, "To").when(F.col("page_id") % 4 == 1, "FROM").otherwise("From")
    headers = F.array(F.struct(F.lit("Date").alias("name"), F.lit("x").alias("value")), F.struct(name.alias("name"), F.col("url").alias("value")), F.struct(name.alias("name"), F.lit("second").alias("value")))
    return t("pages").select("page_id", X.header_value(headers, "from").alias("out"))


@query("b15_pick_body", """select page_id, case when page_id % 3 = 0 then url when page_id % 3 = 1 then url end as plain,
  case when page_id % 3 = 0 then html when page_id % 3 = 1 then '<pre>' || replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</pre>' else '<p>No content</p>' end as shown from pages""")
def _(t):
    part = lambda kind, data: F.struct(F.lit(kind).alias("mime_type"), data.alias("data"))
    plain, first, last = part("text/plain", F.col("url")), part("text/html", F.lit("<p>first</p>")), part("text/html", F.col("html"))
    parts = F.when(F.col("page_id") % 3 == 0, F.array(plain, first, last)).when(F.col("page_id") % 3 == 1, F.array(plain, part("text/plain", F.lit("second")))).otherwise(F.array(part("image/png", F.lit("x"))))
    return t("pages").withColumn("parts", parts).select("page_id", X.pick_body(F.col("parts")).alias("plain"), X.pick_body(F.col("parts"), True).alias("shown"))


@query("b16_inline_cid", "select page_id, '<img src=\"data:image/png;base64,AA\"><img src=\"data:image/gif;base64,BB\">' || html as out from pages")
def _(t):
    urls = F.create_map(F.lit("a"), F.lit("data:image/png;base64,AA"), F.lit("a2"), F.lit("data:image/gif;base64,BB"))
    return t("pages").select("page_id", X.inline_cid(F.concat(F.lit('<img src="cid:a"><img src="cid:a2">'), F.col("html")), urls).alias("out"))


@query("b18_display_html")
def _(t):
    return t("pages").select("page_id", H.display_html(F.col("html")).alias("out"))


def _escaped(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


#: Markup without nesting around the printable ASCII of each document, with what has to go.
_STYLE = "'<html><head><style>@import \"x.css\"; p{color:red}</style></head><body>'"
_PLAIN = "regexp_replace(text, '[^!-~ ]', ' ')"
_MARKUP = f"concat({_STYLE}, '<p onclick=\"x()\" class=\"c', doc_id, '\">', {_escaped(_PLAIN)}, '</p><script>bad()</script><!-- no --><a href=\"javascript:x\">link</a><img src=\"cid:1\" alt=\"page ', doc_id, '\"></body></html>')"
_CLEANED = f"concat('<p class=\"c', doc_id, '\">', {_escaped('t')}, '</p><a>link</a><img src=\"cid:1\" alt=\"page ', doc_id, '\">')"
_FLAT_SQL = "(select doc_id, source, regexp_replace(text, '[^!-~ ]', ' ', 'g') as t from documents)"
_LINE_SQL = "case when trim(t) = '' then '' else regexp_replace(trim(t), ' +', ' ', 'g') || chr(10) end || 'link'"


def _flat(t):
    return t("documents").select("doc_id", F.concat(F.lit("<b>About</b> &amp; "), "source").alias("subject"), F.expr(_MARKUP).alias("body"))


@query("b10_flat_markup", f"select doc_id, '<style> p{{color:red}}</style>' || {_CLEANED} as out from {_FLAT_SQL}")
def _(t):
    return _flat(t).select("doc_id", H.sanitize_html(F.col("body")).alias("out"))


@query("b12_flat_text", f"select doc_id, {_LINE_SQL} as out from {_FLAT_SQL}")
def _(t):
    return _flat(t).select("doc_id", H.html_to_text(F.col("body")).alias("out"))


@query("b8_flat_mail", f"select doc_id, subject, {footer_sql('c')} as body from (select doc_id, 'About & ' || source as subject, {CLEAN_SQL} as c from (select doc_id, source, {_LINE_SQL} || '[An image of page ' || doc_id || ']' as t from {_FLAT_SQL}))")
def _(t):
    return H.simplify_mail(_flat(t))


@query("b18_flat_page", f"select doc_id, '{H.SHELL_START}' || '<style> p{{color:red}}</style>' || chr(10) || '</head>' || chr(10) || '<body>' || {_CLEANED} || '</body>' || chr(10) || '</html>' as out from {_FLAT_SQL}")
def _(t):
    return _flat(t).select("doc_id", H.display_html(F.col("body")).alias("out"))


@query("b19_custom_ids", "select email_id, cast(user_id as varchar) || '_' || email_id as custom_id, cast(user_id as integer) as user_id, email_id || '_x' as rest, case when user_id % 2 = 0 then null else cast(user_id as integer) end as odd from m_item")
def _(t):
    made = X.make_custom_id(F.col("user_id"), F.concat("email_id", F.lit("_x")))
    odd = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("x"), F.col("user_id").cast("string"), F.lit("_m"))).otherwise(F.concat(F.col("user_id").cast("string"), F.lit("_m")))
    rows = t("m_item").select("email_id", X.make_custom_id(F.col("user_id"), F.col("email_id")).alias("custom_id"), X.parse_custom_id(made).alias("p"), X.parse_custom_id(odd).alias("o"))
    return rows.select("email_id", "custom_id", F.col("p.user_id").alias("user_id"), F.col("p.email_id").alias("rest"), F.col("o.user_id").alias("odd"))


@query("b21_count_tokens", "select doc_id, cast(len(string_split(text, ' ')) as bigint) as n from documents")
def _(t):
    return t("documents").select("doc_id", count_tokens(F.col("text"), lambda: lambda s: s.split(" ")).alias("n"))


@query("b21_public_tokens")
def _(t):
    return t("documents").select("doc_id", count_tokens(F.col("text")).alias("n"))


_CAT = X.CATEGORIZE.replace("'", "''").replace("%s", "{}")
_TASK = X.EXTRACT_TASKS.replace("'", "''").replace("%s", "{}")
_SYS = X.SYSTEM.replace("'", "''").replace("%s", "{}")


@query("b22_prompts", f"select email_id, format('{_CAT}', subject, email_id, body) as categorize, format('{_TASK}', subject, body) as tasks, format('{_SYS}', 'Be brief.', '{X.SYSTEM_PREAMBLE}', subject, 'general_category, specific_type') as system from m_item")
def _(t):
    s, b = F.col("subject"), F.col("body")
    return t("m_item").select("email_id", X.categorization_prompt(s, F.col("email_id"), b).alias("categorize"), X.task_prompt(s, b).alias("tasks"), X.system_prompt(s, F.lit("Be brief.")).alias("system"))


@query("b23_missing_scopes", "select id, case id % 3 when 0 then 'a,c' when 1 then 'a,b,c' else 'b' end as missing from m_user")
def _(t):
    granted = F.when(F.col("id") % 3 == 0, "b x").when(F.col("id") % 3 == 1, F.lit(None).cast("string")).otherwise("c a")
    return t("m_user").select("id", F.array_join(X.missing_scopes(granted, ["a", "b", "c"]), ",").alias("missing"))


_CHUNKS = r"""select {keep}, row_number() over (partition by {by} order by i) - 1 as chunk_index, chunk_text from (
  select {keep}, i, case when strlen(s) <= 32768 then s else left(s, len(list_filter(range(1, len(s) + 1), lambda k: strlen(left(s, k)) <= 32768))) end as chunk_text from (
    select {keep}, i, trim(parts[i], {ws}) as s from (select {keep}, parts, unnest(range(1, len(parts) + 1)) as i from (
      select {keep}, string_split(regexp_replace({src}, '([.!?])\s+|\[LINK\]', '\1' || chr(1), 'g'), chr(1)) as parts from {table}))) where regexp_matches(s, '[\p{{L}}\p{{M}}]{{2}}'))"""
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("k1_chunk_text", "select doc_id, cast(chunk_index as integer) as chunk_index, chunk_text from (" + _CHUNKS.format(keep="doc_id", by="doc_id", ws=_WS, src=f"trim(text, {_WS})", table="documents") + ")")
def _(t):
    return K.chunk_text(t("documents"), "text", "doc_id")


@query("k2_chunk_email", "select email_id, cast(chunk_index as integer) as chunk_index, chunk_text from (" + _CHUNKS.format(keep="email_id", by="email_id", ws=_WS, src=f"'Subject of ' || subject || '. ' || trim(body, {_WS})", table="m_item") + ")")
def _(t):
    return K.chunk_email(t("m_item").withColumn("subject", F.concat(F.lit("Subject of "), F.col("subject"), F.lit(". "))), "subject", "body", "email_id")


@query("k3_embedding_batches", "select user_id, cast(b as integer) as batch, string_agg(chunk_text, '|' order by chunk_text) as chunks from (select user_id, chunk_text, (row_number() over (partition by user_id order by cast(substr(email_id, 2) as integer), chunk_index) - 1) // 16 as b from m_embedding where chunk_text is not null) group by 1, 2")
def _(t):
    rows = t("m_embedding").where("chunk_text is not null").withColumn("arrival", F.substring("email_id", 2, 9).cast("int"))
    out = K.embedding_batches(rows, 16, "user_id", "arrival", "chunk_index")
    return out.select("user_id", "batch", F.array_join(F.array_sort("chunks"), "|").alias("chunks"))


@query("c8_should_embed", "select e.id, r.priority from m_email e join m_system_rule r on r.semantic_key = e.ai_answer where r.priority >= 2")
def _(t):
    rules = t("m_system_rule").select(F.col("semantic_key").alias("ai_answer"), "priority")
    return K.should_embed(t("m_email").join(rules, "ai_answer").select("id", "priority"))
