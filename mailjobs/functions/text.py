"""Text cleaning and other string functions, all Column -> Column and inside Spark.

``(?U)`` gives classes and boundaries their Unicode meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define cleaning.
TABS, NEWLINES, SPACES, DIVIDERS = r"[\t]+", r"[\n\r]+", r" {2,}", r"[-=_*]{3,}"
LINK = r"(?U)https?://(www\.)?[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_+.~#?&/=]*)"
IMAGE = r"""<img[^>]*alt=["']([^"']*)["'][^>]*/?>"""
NON_WORDS = (
    r"(?U)\b[a-fA-F0-9]{32,}\b",
    r"(?U)\b[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}\b",
    r"(?<![a-zA-Z0-9+/])[a-zA-Z0-9+/]{40,}+={0,2}",  # tried where a run begins only, which finds the same
    r"(?U)\b[a-zA-Z0-9_-]{30,}\b",
)
EMOJI = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{1F900}-\x{1F9FF}"
    r"\x{1FA00}-\x{1FA6F}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F100}-\x{1F1FF}"
)
ASCII_PUNCTUATION = r"!-/:-@\[-`{-~"
NON_TEXT = r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}" + ASCII_PUNCTUATION + EMOJI + "]"
FOOTER = r"(?iU)(^|\s)(unsubscribe|opt[- ]?out|manage\s+(your\s+)?(email\s+)?preferences|email\s+preferences|update\s+(your\s+)?preferences|sent\s+from\s+(my\s+)?(iphone|ipad|android|samsung|galaxy|mobile|outlook)|get\s+outlook\s+for|this\s+(email|message)\s+(is\s+)?(was\s+)?sent\s+(to|from)|confidential(ity)?(\s+notice)?|this\s+(e-?mail|message)\s+(and\s+any\s+attachments\s+)?(is|are|may\s+be)\s+(intended|privileged|confidential)|if\s+you\s+(are\s+not|have\s+received)\s+(the\s+intended|this\s+(e-?mail|message)\s+in\s+error)|please\s+(delete|disregard|notify)|privacy\s+policy|terms\s+(of\s+service|and\s+conditions)|all\s+rights\s+reserved|©\s*\d{4}|\d{4}\s*©|view\s+(this\s+)?(email\s+)?in\s+(your\s+)?browser|trouble\s+viewing|add\s+us\s+to\s+your\s+address\s+book|you('re|\s+are)\s+(receiving|getting)\s+this\s+(email|message|because))"
CSS_URL = r"""(?i)url\s*\(\s*(?:"[^"]*"|'[^']*'|[^)]*)\s*\)"""
CSS_IMPORT = r"""(?i)@import\s+(?:url\s*\([^)]*\)|['"][^'"]*['"])[^;]*;"""
HEAD, BODY = r"(?is)<head[^>]*>(.*?)</head>", r"(?is)<body[^>]*>(.*?)</body>"


def replace_links(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, LINK, "[LINK]"), F.lit("([LINK]"), F.lit("[LINK]"))


def replace_images(c: Column) -> Column:
    return F.regexp_replace(c, IMAGE, "[An image of $1]")


def strip_non_words(c: Column) -> Column:
    """Removes hashes, UUIDs, base64 and long tokens, in that order."""
    for pattern in NON_WORDS:
        c = F.regexp_replace(c, pattern, "")
    return c


def strip_non_text(c: Column) -> Column:
    """Keeps letters, numbers, white space, ASCII punctuation and common emoji."""
    return F.regexp_replace(c, NON_TEXT, "")


def strip_formatting(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, TABS, " "), NEWLINES, "\n")
    return F.regexp_replace(F.regexp_replace(c, DIVIDERS, " "), SPACES, " ")


def strip_footer(c: Column) -> Column:
    """Cuts at the first footer phrase and trims the end; without a phrase the text stays as it is."""
    return F.when(c.rlike(FOOTER), F.regexp_replace(F.element_at(F.split(c, FOOTER, 2), 1), r"(?U)\s+$", "")).otherwise(c)


def simplify_text(c: Column) -> Column:
    """The chain for plain text. It doesn't cut footers."""
    return strip_formatting(strip_non_text(strip_non_words(replace_links(c))))


def tidy_body(c: Column) -> Column:
    """The part of the mail chain that follows the HTML steps; it does cut footers."""
    return strip_footer(simplify_text(c))


def tidy_subject(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, TABS, " "), SPACES, " ")


def render_message(subject: Column, body: Column) -> Column:
    none = F.lit("")
    return F.format_string("<subject>%s</subject> <body>%s</body>", F.coalesce(subject, none), F.coalesce(body, none))


def sanitize_css(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, CSS_IMPORT, ""), CSS_URL, "")


def extract_head(html: Column) -> Column:
    return F.when(html.rlike(HEAD), F.regexp_extract(html, HEAD, 1))


def extract_body(html: Column) -> Column:
    return F.when(html.rlike(BODY), F.regexp_extract(html, BODY, 1))


def fold(c: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def header_value(headers: Column, name: str) -> Column:
    """The first header of that name, in any case of its ASCII letters."""
    return F.try_element_at(F.filter(headers, lambda h: fold(h["name"]) == name.lower()), F.lit(1))["value"]


def html_escape(c: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def pick_body(parts: Column, display: bool = False) -> Column:
    """The body of a flat list of parts (mime_type, data): plain text first, or, for display, the last
    HTML part, else the first plain one escaped into <pre>, else a line that says there is none."""
    of = lambda kind: F.transform(F.filter(parts, lambda p: (p["mime_type"] == kind) & p["data"].isNotNull()), lambda p: p["data"])
    first_plain = F.try_element_at(of("text/plain"), F.lit(1))
    if not display:
        return first_plain
    html = F.try_element_at(of("text/html"), F.lit(-1))
    return F.coalesce(html, F.concat(F.lit("<pre>"), html_escape(first_plain), F.lit("</pre>")), F.lit("<p>No content</p>"))


def inline_cid(html: Column, data_urls: Column) -> Column:
    """Replaces cid:KEY by its data URL; longer keys first, so that no key cuts into another."""
    entries = F.array_sort(F.map_entries(data_urls), lambda a, b: F.length(b["key"]) - F.length(a["key"]))
    return F.aggregate(entries, html, lambda text, e: F.replace(text, F.concat(F.lit("cid:"), e["key"]), e["value"]))


def make_custom_id(user_id: Column, email_id: Column) -> Column:
    return F.concat_ws("_", user_id.cast("string"), email_id)


def parse_custom_id(c: Column) -> Column:
    """struct(user_id, email_id); null without an underscore or with a user that isn't an integer."""
    parts = F.split(c, "_", 2)
    user = F.when(F.element_at(parts, 1).rlike(r"^[+-]?[0-9]+$"), F.element_at(parts, 1).try_cast("int"))
    return F.when((F.size(parts) == 2) & user.isNotNull(), F.struct(user.alias("user_id"), F.try_element_at(parts, F.lit(2)).alias("email_id")))


def estimate_tokens(c: Column) -> Column:
    """A quarter of the bytes."""
    return F.floor(F.octet_length(c) / 4).cast("long")


# The wording of the prompts.
CATEGORIZE = """Categorize the following email based on subject, sender, and body.
Only select a category when it is strongly correlated with the content. If you cannot select a category confidently, respond with "Unknown".
Make a reasonable choice based on the intent, formatting, tone, and typical conventions.

<subject>%s</subject>
<sender>%s</sender>
<body>%s</body>"""
EXTRACT_TASKS = """Extract any actionable tasks from the following email.
                <subject>%s</subject>
                <body>%s</body>"""
SYSTEM = """You are an email classification engine.
%s

Instructions:
%s

Taxonomy (authoritative):

%s

You will only respond with a JSON object with the keys %s, and confidence.
"confidence" is a float between 0 and 1 representing classification certainty.
Do not provide explanations."""
SYSTEM_PREAMBLE = "Your task is to categorize the given email into one general category and one specific category from the predefined taxonomy below."
USER_PREAMBLE = "Your task is to categorize the given email into one specific type from the predefined taxonomy below."


def _filled(template: str, *values: Column) -> Column:
    return F.format_string(template, *(F.coalesce(v, F.lit("")) for v in values))


def categorization_prompt(subject: Column, sender: Column, body: Column) -> Column:
    return _filled(CATEGORIZE, subject, sender, body)


def task_prompt(subject: Column, body: Column) -> Column:
    return _filled(EXTRACT_TASKS, subject, body)


def system_prompt(taxonomy: Column, instructions: Column, user_defined: bool = False) -> Column:
    """The instructions come first and the fixed sentence stands under "Instructions", as the service
    sends it."""
    preamble, keys = (USER_PREAMBLE, "specific_type") if user_defined else (SYSTEM_PREAMBLE, "general_category, specific_type")
    return F.format_string(SYSTEM, instructions, F.lit(preamble), taxonomy, F.lit(keys))


def missing_scopes(granted: Column, required: list[str]) -> Column:
    """Required scopes that a blank-separated list lacks, in their own order."""
    return F.array_except(F.array(*map(F.lit, required)), F.split(F.coalesce(granted, F.lit("")), " "))
