"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Measurements of every document, with the windows found by joining positions.
QUALITY_LEDGER = rf"""
with d as (
  select row_number() over () as k, doc_id, coalesce(text, '') as text, {_WORDS} as w from documents
), windows as (
  select k, unnest(range(1, len(w) - 3)) as i, w from d where len(w) >= 5
), keyed as (
  select k, i, array_to_string(w[i:i+4], ' ') as g from windows
), again as (
  select k, i from (select k, i, count(*) over (partition by k, g) as n from keyed) where n > 1
), covered as (
  select k, count(distinct i + o) as n_repeat_words from again, (select unnest(range(0, 5)) as o) group by k
), lines as (
  select k, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select k, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by k
), m as (
  select d.doc_id, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    coalesce(n_lines, 0) as n_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{Lu}}') and not regexp_matches(x, '\p{{Ll}}'))) as n_upper_words,
    length(text) - length(replace(text, '!', '')) as n_exclaim
  from d left join covered using (k) left join lines using (k)
), b as (
  select *, (case when n_words < 10 then 1 else 0 end) + (case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end)
    + (case when 10 * n_symbols > n_words then 4 else 0 end) + (case when 2 * n_dup_lines > n_lines then 8 else 0 end)
    + (case when 2 * n_upper_words > n_words then 16 else 0 end) + (case when 2 * n_exclaim > n_words then 32 else 0 end)
    + (case when word_chars < 2 * n_words then 64 else 0 end) + (case when word_chars > 15 * n_words then 128 else 0 end) as fail_bits
  from m
)
"""

_NAMES = ("few_words", "repeated_windows", "symbols", "duplicate_lines", "shouting", "exclamations", "short_words", "long_words")
_POLICIES = {"base": 2, "v1": 4, "v2": 8}


def _ablations() -> str:
    rows = ", ".join(f"('{p}', '{_NAMES[k]}', {1 << k}, {(1 << n) - 1})" for p, n in _POLICIES.items() for k in range(n))
    return (
        QUALITY_LEDGER
        + f"""select policy, rule, count_if(fail_bits & bit <> 0)::bigint as n_failed, count_if(fail_bits & mask = bit)::bigint as n_only_this,
  count_if(fail_bits & mask <> 0)::bigint as n_rejected
from b, (values {rows}) as v(policy, rule, bit, mask) group by 1, 2"""
    )


_MIXING = r"""
with s as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as o from documents
), per as (
  select source, cast(sum(size) as bigint) as source_size from s group by source
), p as (
  select *, row_number() over (order by source nulls last) - 1 as place from per
), w as (
  select *, cast(place % 3 + 1 as double) as weight, source_size * 3.0::double as cap from p
), l as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0)) as lvl from w
), t as (
  select *, case when cap / weight <= lvl then cap else weight * max(case when cap / weight > lvl then lvl end) over () end as target from l
), c as (
  select s.doc_id, s.size, t.source_size, t.target, t.place, cast(round(t.target) as bigint) as whole,
    coalesce(sum(s.size) over (partition by t.place order by s.o, s.doc_id nulls last, s.size rows between unbounded preceding and 1 preceding), 0) as b
  from s join t on s.source is not distinct from t.source
), e as (
  select *, list_filter(range(0, 3), lambda e: least(size, whole - b - e * source_size) > 0) as epochs,
    case place % 3 when 0 then 1.5 when 1 then 1.0 else 0.5 end::double as w0, case place % 3 when 0 then -1.0 when 1 then 0.0 else 1.0 end::double as slope from c
)
select doc_id, size, source_size, target,
  cast(coalesce(list_sum(list_transform(epochs, lambda e: least(size, whole - b - e * source_size))), 0) as bigint) as taken,
  cast(len(epochs) as bigint) as n_copies,
  array_to_string(list_transform(list_transform(epochs, lambda e: (b + e * source_size) / target),
    lambda u: cast(floor(least(2 * u / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * u, 0))), 1) * 1e6) as bigint)), ',') as positions
from e
"""


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _host(url: str) -> str:
    return f"(case when instr({url}, '://') > 0 then translate(regexp_extract(substr({url}, instr({url}, '://') + 3), '^[^/?#]*'), {_AZ}) else '' end)"


#: Rules by join; ranks as the sum over walks from the seeds, so many links that what is left is under 1e-6.
_URLS = rf"""
with recursive u as (
  select row_number() over () as k, page_id, coalesce(url, '') as url, html from pages
), h as (
  select *, {_host('url')} as host, case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path from u
), rules(rule, v, rh, rp) as (
  values ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
), m as (
  select k, first(rule order by length(rule) desc, rule) as rule from h join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by k
), j as (
  select h.*, m.rule, r.v, r.rp from h left join m using (k) left join rules r on r.rule = m.rule
), seeds as (
  select host, avg(case when v = 'allow' then 1.0 else 0.0 end) as t, avg(case when v = 'block' and rp in ('', '/') then 1.0 else 0.0 end) as d from j where host <> '' group by host
), links as (
  select host as src, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]+)', 1)) as l from h
), e as (
  select src, dst, count(*) as n from (select src, {_host("(case when l[1:2] = '//' then 'http:' || l else l end)")} as dst from links) where src <> '' and dst <> '' and src <> dst group by 1, 2
), steps as (
  select 't' as kind, src as host, dst as nxt, n / sum(n) over (partition by src) as w from e union all select 'd', dst, src, n / sum(n) over (partition by dst) from e
), walk(i, kind, host, r) as (
  select 0, kind, host, r from (select 't' as kind, host, 0.15 * t / sum(t) over () as r from seeds where t > 0 union all select 'd', host, 0.15 * d / sum(d) over () from seeds where d > 0)
  union all select i + 1, kind, nxt, sum(0.85 * w * r) from walk join steps using (kind, host) where i < 86 group by i, kind, nxt
), ranks as (
  select host, coalesce(sum(r) filter (kind = 't'), 0) as t, coalesce(sum(r) filter (kind = 'd'), 0) as d from walk group by host
)
select page_id, j.host, path, rule, coalesce(v, case when coalesce(d, 0) > 0 and d >= 0.5 * (t + d) then 'block' else 'allow' end) as verdict
from j left join ranks using (host)
"""

_B = r"[ \t\n\r\f\v]"
#: Units with their offsets; the normalised text itself stands for its digest.
_SUBSTRINGS = rf"""
with l as (
  select doc_id, i, line, coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
), cut as (
  select doc_id, i, pos, string_split(regexp_replace(line, '([.!?])([ \t\r\f\v])', '\1' || chr(1) || '\2', 'g'), chr(1)) as parts from l
), s as (
  select doc_id, i, piece, pos + coalesce(sum(length(piece)) over (partition by doc_id, i order by k rows between unbounded preceding and 1 preceding), 0) as pos
  from (select doc_id, i, pos, unnest(parts) as piece, generate_subscripts(parts, 1) as k from cut)
), p as (
  select doc_id, i, pos + length(regexp_extract(piece, '^{_B}*')) as b, pos + length(regexp_replace(piece, '{_B}+$', '')) as e, regexp_extract_all(lower(piece), '[^ \t\n\r\f\v]+') as w from s where regexp_matches(piece, '[^ \t\n\r\f\v]')
), c as (
  select *, sum(len(w)) over (partition by doc_id order by b) as upto, list(w) over (partition by doc_id order by b rows between unbounded preceding and unbounded following) as ws from p
), k as (
  select doc_id, b, upto - len(w) as before, upto - len(w) + 16 as need from c
), u as (
  select k.doc_id, k.b, c.e, array_to_string(flatten(c.ws)[k.before + 1:c.upto], ' ') as g from k asof join c on k.doc_id = c.doc_id and k.need <= c.upto
  union
  select doc_id, min(b), max(e), array_to_string(flatten(list(w order by b)), ' ') from p group by doc_id, i having count(*) > 1 and sum(len(w)) >= 16
), f as (
  select *, first_value((doc_id, b)) over (partition by g order by doc_id, b) as first from u
), lost as (
  select distinct doc_id, b, e from f where (doc_id, b) <> first
), marked as (
  select *, case when b <= max(e) over (partition by doc_id order by b, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from lost
), merged as (
  select doc_id, min(b) as b, max(e) as e, count(*) as n from (select *, sum(fresh) over (partition by doc_id order by b, e) as island from marked) group by doc_id, island
), per as (
  select doc_id, sum(n) as n, sum(e - b) as c, string_agg(cast(b as varchar) || ':' || cast(e as varchar), ',' order by b) as spans from merged group by doc_id
)
select doc_id, cast(coalesce(n, 0) as bigint) as n_removed, cast(coalesce(c, 0) as bigint) as n_removed_chars, cast(length(coalesce(text, '')) - coalesce(c, 0) as bigint) as kept_chars, coalesce(spans, '') as removed_spans
from documents left join per using (doc_id)
"""


def _located(source: str, pattern: str, group: int = 0, least: int = 0) -> str:
    """(k, b, e, m, v) of a pattern's matches in rows (k, o, t), moved by o, and the group that is measured:
    each begins where the text before it ends."""
    quoted = pattern.replace("'", "''")
    return f"""(select k, o + e - length(m) as b, o + e as e, m, v from (
      select k, o, m, v, sum(length(gap) + length(m)) over (partition by r order by i) as e from (
        select r, k, o, unnest(ms) as m, unnest(ps[1:len(ms)]) as gap, unnest(vs) as v, generate_subscripts(ms, 1) as i from (
          select row_number() over () as r, k, o, regexp_extract_all(t, '{quoted}', 0) as ms, string_split_regex(t, '{quoted}') as ps, regexp_extract_all(t, '{quoted}', {group}) as vs from {source}))) where length(v) >= {least})"""


def _tail(z: str) -> str:
    t = f"(1 / (1 + 0.2316419::double * least(abs({z}), 30)))"
    poly = "0.0::double"
    for c in reversed(("0.319381530", "-0.356563782", "1.781477937", "-1.821255978", "1.330274429")):
        poly = f"(({poly} + {c}::double) * {t})"
    tail = f"(exp(-least(abs({z}), 30) * least(abs({z}), 30) / 2) / 2.5066282746310002::double * {poly})"
    return f"(case when {z} >= 0 then {tail} else 1 - {tail} end)"


def _secrets() -> str:
    import math

    from .secrets import BINS, CANDIDATE, ENCODINGS, FISHER_VAR, KINDS, LEAST, LONE_BITS, LONE_CUT, MIN_CLASS, PARTS, SHORT_CUT

    base = " union all ".join(f"select k, {n} as kind, b, e, v from {_located('d', pattern, group, least)}" for n, (_, pattern, group, least) in enumerate(KINDS))
    fits = lambda give: "case " + " ".join(f"when regexp_matches(body, '{p}') then {give(name, letters)}" for name, p, letters in ENCODINGS) + " end"
    counts = ", ".join(f"cast(count(*) filter (kind = {k}) as bigint) as n_{name}" for k, (name, *_) in enumerate(KINDS))
    named = lambda last: "case kind " + " ".join(f"when {k} then '{name}'" for k, (name, *_) in enumerate(KINDS)) + f" else '{last}' end"
    written = f"{named('random')} || ':' || cast(b as bigint) || ':' || cast(e as bigint)"
    parts = f"parts0 as (select k, b, e, m from {_located('d', CANDIDATE)})"
    for n, (pattern, whole) in enumerate(PARTS):
        odd = f"(select k, b as o, m as t from parts{n} where not regexp_matches(m, '{whole}'))"
        parts += f", parts{n + 1} as (select k, b, e, m from parts{n} where regexp_matches(m, '{whole}') union all select k, b, e, m from {_located(odd, pattern)})"
    mu = "(2 * high * (n - high) / n + 1)"
    var = f"(({mu} - 1) * ({mu} - 2) / (n - 1))"
    return f"""
with d as (
  select row_number() over () as k, 0 as o, doc_id, coalesce(text, '') as t from documents
), base as ({base}), {parts}, c as (
  select row_number() over () as c, *, rtrim(v, '=') as body from (
    select k, kind, b, e, v from base
    union all select k, {len(KINDS)}, b, e, m from parts{len(PARTS)} r where length(m) >= {LEAST} and regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')
      and not exists (select 1 from base x where x.k = r.k and x.b < r.e and r.b < x.e))
), f as (
  select *, {fits(lambda name, letters: f"'{name}'")} as enc, {fits(lambda name, letters: f"'{letters}'")} as letters from c
), chars as (
  select c, i, length(letters)::double as ka, (instr(letters, x) - 1)::double as v from (select c, letters, unnest(string_split(body, '')) as x, generate_subscripts(string_split(body, ''), 1) as i from f where enc is not null and length(body) >= {LEAST})
), w as (
  select *, lag(v) over (partition by c order by i) as u, avg(v) over (partition by c) as mean, count(*) over (partition by c, v)::double as same from chars
), s as (
  select c, any_value(ka) as ka, count(*)::double as n, sum(same) as squares, count(*) filter (v >= ka / 2)::double as high,
    1 + count(*) filter (u is not null and (v >= ka / 2) <> (u >= ka / 2))::double as runs, sum((v - mean) * (v - mean)) as spread, coalesce(sum((v - mean) * (u - mean)), 0) as serial from w group by c
), pairs as (
  select *, (squares - n) / 2 as equal, n * (n - 1) / 2 as np, 1 / ka as pu from s
), central as (
  select *, np * pu * (1 - pu) as v2, np * pu * (1 - pu) * (1 - 2 * pu) + n * (n - 1) * (n - 2) * pu * pu * (1 - pu) as v3 from pairs
), shape as (
  select *, (equal - np * pu) / sqrt(v2) as z, 4 / ((v3 / (v2 * sqrt(v2))) * (v3 / (v2 * sqrt(v2)))) as a from central
), cube as (
  select *, (pow(greatest(1 + z / sqrt(a), 0), 1 / 3.0::double) - (1 - 1 / (9 * a))) * 3 * sqrt(a) as y from shape
), p as (
  select *, greatest({_tail("y")}, 1e-300) as p1, greatest(case when {var} > 0 then 2 * {_tail(f"abs((runs - {mu}) / sqrt({var}))")} else 0 end, 1e-300) as p2,
    greatest(case when spread > 0 then 2 * {_tail("abs((serial / spread + 1 / n) * sqrt(n))")} else 0 end, 1e-300) as p3 from cube
), fisher as (
  select c, ka, n, least(greatest({_tail("y")}, 0), 1) as p from (
    select *, (pow(greatest(1 + (-2 * (ln(p1) + ln(p2) + ln(p3)) - 6) / {math.sqrt(FISHER_VAR)!r}::double / {math.sqrt(36 / FISHER_VAR)!r}::double, 0), 1 / 3.0::double) - (1 - {FISHER_VAR / 36 / 9!r}::double)) * {3 * math.sqrt(36 / FISHER_VAR)!r}::double as y from (select * exclude (y) from p))
), binned as (
  select fisher.*, k, kind, b, e, enc, floor(log2(n)) as oct, least(floor(p * {BINS}), {BINS - 1}) as bin from fisher join f using (c)
), classes as (
  select distinct enc, oct, ka from binned
), widths as (
  select enc, oct, min(width) as width from (
    select x.enc, x.oct, width from classes x, binned y, (select unnest(range(0, 32)) as width) where y.enc = x.enc and abs(y.oct - x.oct) <= width group by x.enc, x.oct, width having count(*) >= {MIN_CLASS}) group by enc, oct
), cuts as (
  select enc, oct, min(cutoff) / {BINS}.0::double as cut from (
    select x.enc, x.oct, cutoff, 2 * count(*) filter (bin >= {BINS // 2}) as random, count(*) filter (bin >= cutoff) as kept
    from widths x join binned y on y.enc = x.enc and abs(y.oct - x.oct) <= width, (select unnest(range(0, {BINS})) as cutoff) group by x.enc, x.oct, cutoff)
  where kept > 0 and random > 0 and 1 - random * (1 - cutoff / {BINS}.0::double) / kept <= 0.1 group by enc, oct
  union all select enc, oct, case when pow(2, oct) * log2(ka) >= {LONE_BITS} then {LONE_CUT} else {SHORT_CUT} end from classes anti join widths using (enc, oct)
), spans as (
  select k, kind, b, e from base union all select k, kind, b, e from binned join cuts using (enc, oct) where kind = {len(KINDS)} and p >= cut
), per as (
  select k, {counts}, coalesce(string_agg({written}, ',' order by b, kind) filter (kind < {len(KINDS)}), '') as bs, string_agg({written}, ',' order by b, kind) as spans from spans group by k
), tests as (
  select k, string_agg({named("candidate")} || ':' || cast(b as bigint) || ':' || enc || ':' || cast(floor(p * 1e4 + 0.5) as bigint), ',' order by b, kind) as tests from binned group by k
)
select doc_id, {", ".join(f"coalesce(n_{name}, 0) as n_{name}" for name, *_ in KINDS)}, sha256(coalesce(bs, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(tests, '') as tests
from d left join per using (k) left join tests using (k)
"""


_HARD_NEGATIVES = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as alike, cast(list_inner_product(a.v, b.v) as bigint) as score from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), p as (select * from s where alike qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id, cast(row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as integer) as rank, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.alike and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score qualify rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": _URLS,
        "op4_mixing": _MIXING,
        "op6_quality_rules": QUALITY_LEDGER
        + "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept, cast(fail_bits as bigint) as fail_bits from b",
        "op8_secret_scan": _secrets(),
        "op10_substring_dedup": _SUBSTRINGS,
        "op12_hard_negatives": _HARD_NEGATIVES,
        "quality_ablations": _ablations(),
    }
