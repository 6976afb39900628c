"""Secret scanning: patterns and a battery of randomness tests, in DataFrame expressions only.

Base kinds (assign, access, hex) are found by pattern. Besides them, runs of encoding characters that
hold letters and digits are candidates. A run is cut behind each '=' that more of it follows (name=value);
a part that still mixes '+' or '/' with '-' or '_' fits no encoding and is cut at '/' (a path), and what
then mixes '+' with them at these. Values of base spans are tested like candidates. For each, the
narrowest encoding that fits is inferred (hex, base32, upper case and digits, lower case and digits,
letters and digits, base64, its URL form), its characters become symbols, and three tests ask whether
they look uniformly random: chi-squared over the alphabet, runs above and below its middle, and serial
correlation of neighbours. Chi-squared is the number of equal pairs but for a constant; few symbols of a
large alphabet make it far from normal, so its tail is that of a gamma variable with the exact mean,
variance and third moment of that number for this length and alphabet. Fisher's method combines the
three into one p-value; since runs and serial correlation see much of the same (their statistics are
correlated by 3/4), its sum is taken as a scaled chi-squared with the variance that follows (Brown).

False-discovery control is per class of encoding and length: among random strings p is uniform, while
words and identifiers pile up near 0. The count of p above one half, doubled, estimates how many strings
of the class are random; the lowest cut whose survivors are at most ``q`` non-random by that estimate is
the class's threshold. The counts of a class of fewer than ``MIN_CLASS`` strings are pooled with those of
the nearest lengths of its encoding until they suffice; where all lengths don't, p itself decides at a
fixed level, a stricter one where strings hold too few bits for the tests to have power. Classes are few
(lengths count by powers of two), so the thresholds are a small map.

Defined results: a null or empty text has no spans; strings of fewer than ``LEAST`` symbols are too short
for the three tests and are never random; offsets are code points, end exclusive; spans of one kind never
overlap, and the method adds none that touches a base span; repeated rows give repeated rows and count
each; other columns take no part, and ``redact`` keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, let, replaced, running

# The patterns of the base kinds, with the group that is measured and its least length.
KINDS: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Kind of the spans that the method adds; it sorts after the base kinds.
RANDOM = "random"
#: Fewest symbols of a string that is tested: the normal tails of runs and serial correlation need as many.
LEAST = 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: What a run is cut into, one after the other, and what is left whole at each step.
PARTS: tuple[tuple[str, str], ...] = (
    (r"[A-Za-z0-9+/_-]+=*", r"^[^=]*=*$"),
    (r"[A-Za-z0-9+_-]+=*", r"^(?:[^+/]*|[^_-]*)$"),
    (r"[A-Za-z0-9+]+=*", r"^(?:[^+/]*|[^_-]*)$"),
)
#: Strings that a threshold rests on at least.
MIN_CLASS = 30
#: Where there are fewer: the cut on p, if the class's shortest strings hold so many bits, and if not.
LONE_BITS, LONE_CUT, SHORT_CUT = 80.0, 0.05, 0.5

# Encodings from narrow to wide, with the pattern that fits and the alphabet in order.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS: tuple[tuple[str, str, str], ...] = (
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("BASE36", r"^[A-Z0-9]+$", DIGITS + UPPER),
    ("base36", r"^[a-z0-9]+$", DIGITS + LOWER),
    ("alnum", r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
SPAN = "array<struct<start:int,kind:int,end:int>>"
FOUND = "array<struct<start:int,end:int,match:string>>"
NAMED = "array<struct<start:int,kind:int,end:int,match:string>>"
BINS = 20
#: Variance of -2 times the sum of the logarithms: 12 if the three were independent, and twice the covariance of the two that aren't.
FISHER_VAR = 12 + 2 * 2.22
LATEST = (1 << 31) - 1


def located(text: Column, found: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the matches ``found`` of ``pattern``: each begins where the
    text before it, cut at the matches, ends."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    pairs = F.zip_with(gaps, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("match")))

    def placed(ps: Column) -> Column:
        at = running(F.transform(ps, lambda p: p["gap"] + F.length(p["match"])), lambda a, b: a + b, 0)
        return F.zip_with(ps, at, lambda p, a: F.struct((a + p["gap"]).alias("start"), (a + p["gap"] + F.length(p["match"])).alias("end"), p["match"].alias("match")))

    return F.when(F.size(found) == 0, F.array().cast(FOUND)).otherwise(let(pairs, placed).cast(FOUND))


def parted(runs: Column) -> Column:
    """Runs (start, end, match) cut into the parts that are tested by themselves."""

    def cut(pattern: str, whole: str):
        def one(r: Column) -> Column:
            inner = located(r["match"], F.regexp_extract_all(r["match"], F.lit(pattern), F.lit(0)), pattern)
            moved = F.transform(inner, lambda p: F.struct((r["start"] + p["start"]).alias("start"), (r["start"] + p["end"]).alias("end"), p["match"].alias("match")))
            return F.when(r["match"].rlike(whole), F.array(r)).otherwise(moved)

        return one

    for pattern, whole in PARTS:
        runs = F.flatten(F.transform(runs, cut(pattern, whole)))
    return F.filter(runs, lambda r: F.length(r["match"]) >= LEAST)


def normal_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal, by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    # Its coefficients.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

    def tail(x: Column) -> Column:
        def poly(t: Column) -> Column:
            out = F.lit(0.0)
            for c in reversed(b):
                out = (out + F.lit(c)) * t
            return out

        return F.exp(-x * x / 2) / F.lit(2.5066282746310002) * let(1 / (1 + 0.2316419 * x), poly)

    return let(z, lambda v: F.when(v >= 0, let(F.least(F.abs(v), F.lit(30.0)), tail)).otherwise(1 - let(F.least(F.abs(v), F.lit(30.0)), tail)))


def gamma_tail(z: Column, skew: Column) -> Column:
    """P(Z > z) for a gamma variable with that skewness, in units of its standard deviation: the cube
    root of such a variable is nearly normal (Wilson and Hilferty)."""
    a = 4 / (skew * skew)
    root = F.pow(F.greatest(1 + z / F.sqrt(a), F.lit(0.0)), F.lit(1 / 3))
    return normal_tail((root - (1 - 1 / (9 * a))) * 3 * F.sqrt(a))


def tested(strings: Column) -> Column:
    """Those of (start, kind, end, match) that can be tested, with encoding, class and combined p-value."""
    kept = ("start", "kind", "end", "encoding")

    def fields(c: Column, names: tuple[str, ...]) -> list[Column]:
        return [c[f].alias(f) for f in names]

    def inferred(c: Column) -> Column:
        body = F.rtrim(c["match"], F.lit("="))
        name = F.lit(None).cast("string")
        for e, pattern, _ in reversed(ENCODINGS):
            name = F.when(body.rlike(pattern), F.lit(e)).otherwise(name)
        return F.struct(*fields(c, kept[:3]), name.alias("encoding"), body.alias("body"))

    def symbols(c: Column) -> Column:
        alphabets = F.create_map(*(F.lit(x) for e, _, letters in ENCODINGS for x in (e, letters)))
        codes = let(F.element_at(alphabets, c["encoding"]), lambda known: F.transform(F.split(c["body"], "(?<=.)(?=.)"), lambda x: (F.instr(known, x) - 1).cast("double")))
        return F.struct(*fields(c, kept), F.length(F.element_at(alphabets, c["encoding"])).cast("double").alias("k"), codes.alias("codes"))

    def pairs(codes: Column, f) -> Column:
        return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), f)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    def sums(c: Column) -> Column:
        codes, k = c["codes"], c["k"]
        squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda s, v: s + F.pow(F.size(F.filter(codes, lambda x: x == v)).cast("double"), F.lit(2.0)))
        high = F.size(F.filter(codes, lambda x: x >= k / 2)).cast("double")
        runs = 1 + total(pairs(codes, lambda x, y: F.when((x >= k / 2) != (y >= k / 2), F.lit(1.0)).otherwise(F.lit(0.0))))
        n = F.size(codes).cast("double")
        return F.struct(*fields(c, (*kept, "k", "codes")), n.alias("n"), squares.alias("squares"), high.alias("high"), runs.alias("runs"), (total(codes) / n).alias("mean"))

    def moments(c: Column) -> Column:
        m = c["mean"]
        spread = total(F.transform(c["codes"], lambda x: (x - m) * (x - m)))
        serial = total(pairs(c["codes"], lambda x, y: (x - m) * (y - m)))
        return F.struct(*fields(c, (*kept, "k", "n", "squares", "high", "runs")), spread.alias("spread"), serial.alias("serial"))

    def chances(c: Column) -> Column:
        n, high, u = c["n"], c["high"], 1 / c["k"]
        low = n - high
        tiny = F.lit(1e-300)
        equal = (c["squares"] - n) / 2  # pairs of equal symbols, each pair equal with chance u
        all_pairs = n * (n - 1) / 2
        var = all_pairs * u * (1 - u)
        third = var * (1 - 2 * u) + n * (n - 1) * (n - 2) * u * u * (1 - u)
        p_chi = gamma_tail((equal - all_pairs * u) / F.sqrt(var), third / (var * F.sqrt(var)))
        mu = 2 * high * low / n + 1
        var_runs = (mu - 1) * (mu - 2) / (n - 1)
        p_runs = F.when(var_runs > 0, 2 * normal_tail(F.abs((c["runs"] - mu) / F.sqrt(var_runs)))).otherwise(tiny)
        p_serial = F.when(c["spread"] > 0, 2 * normal_tail(F.abs((c["serial"] / c["spread"] + 1 / n) * F.sqrt(n)))).otherwise(tiny)
        half = -(F.log(F.greatest(p_chi, tiny)) + F.log(F.greatest(p_runs, tiny)) + F.log(F.greatest(p_serial, tiny)))
        p = gamma_tail((2 * half - 6) / math.sqrt(FISHER_VAR), F.lit(math.sqrt(FISHER_VAR) / 3))
        return F.struct(*fields(c, kept), F.concat_ws(":", c["encoding"], F.floor(F.log2(n)).cast("string")).alias("label"), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"))

    out = F.filter(F.transform(strings, inferred), lambda c: c["encoding"].isNotNull() & (F.length(c["body"]) >= LEAST))
    for stage in (symbols, sums, moments, chances):
        out = F.transform(out, stage)
    return out


def untouched(parts: Column, base: Column) -> Column:
    """Of ``parts`` (start, end, match) those that no base span overlaps: both are put in one order, and
    no base span before a part may end behind its start, none after it start before its end."""
    place = lambda start, part, end, match: F.struct(start.alias("start"), F.lit(part).alias("part"), end.alias("end"), match.alias("match"))
    both = F.array_sort(F.concat(F.transform(base, lambda b: place(b["start"], 0, b["end"], F.lit(""))), F.transform(parts, lambda p: place(p["start"], 1, p["end"], p["match"]))))

    def kept(marks: Column) -> Column:
        ended = running(F.transform(marks, lambda m: F.when(m["part"] == 0, m["end"]).otherwise(0)), F.greatest, 0)
        next_start = F.reverse(running(F.reverse(F.transform(marks, lambda m: F.when(m["part"] == 0, m["start"]).otherwise(LATEST))), F.least, LATEST))
        bounds = F.zip_with(ended, next_start, lambda a, b: F.struct(a.alias("ended"), b.alias("next")))
        free = F.filter(F.zip_with(marks, bounds, lambda m, b: F.struct(m.alias("m"), b.alias("b"))), lambda x: (x["m"]["part"] == 1) & (x["b"]["ended"] <= x["m"]["start"]) & (x["b"]["next"] >= x["m"]["end"]))
        return F.transform(free, lambda x: F.struct(x["m"]["start"].alias("start"), x["m"]["end"].alias("end"), x["m"]["match"].alias("match")))

    return F.when((F.size(parts) == 0) | (F.size(base) == 0), parts).otherwise(let(both, kept).cast(FOUND))


def scan(docs: DataFrame) -> DataFrame:
    """Adds ``__base`` (start, kind number, end, the value as match) and ``__tested`` (base values and
    candidates with p-values) to every row; one narrow stage over the whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs
    for name, pattern, _, _ in KINDS:
        found = found.withColumn(f"__{name}", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    found = found.withColumn("__runs", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    spans = []
    for k, (name, pattern, group, least) in enumerate(KINDS):
        matches = F.col(f"__{name}")
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
        named = F.zip_with(located(text, matches, pattern), values, lambda p, v: F.struct(p["start"].alias("start"), F.lit(k).alias("kind"), p["end"].alias("end"), v.alias("match")))
        spans.append(F.when(F.size(matches) == 0, F.array().cast(NAMED)).otherwise(F.filter(named, lambda s: F.length(s["match"]) >= least).cast(NAMED)))
    found = found.withColumn("__base", F.array_sort(F.concat(*spans)))
    worth = F.exists("__runs", lambda r: r.rlike("[0-9]") & r.rlike("[A-Za-z]"))
    parts = F.filter(parted(located(text, F.col("__runs"), CANDIDATE)), lambda r: r["match"].rlike("[0-9]") & r["match"].rlike("[A-Za-z]"))
    found = found.withColumn("__parts", F.when(worth, parts).otherwise(F.array().cast(FOUND)))
    found = found.withColumn("__free", untouched(F.col("__parts"), F.col("__base")))
    free = F.transform("__free", lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), c["end"].alias("end"), c["match"].alias("match"))).cast(NAMED)
    found = found.withColumn("__strings", F.concat("__base", free))
    return found.withColumn("__tested", tested(F.col("__strings"))).drop("__runs", "__parts", "__free", "__strings", *(f"__{name}" for name, *_ in KINDS))


def lone_cut(encoding: str, octave: int) -> float:
    """The cut on p of a class that is too small for an estimate."""
    size = next(len(letters) for e, _, letters in ENCODINGS if e == encoding)
    return LONE_CUT if (1 << octave) * math.log2(size) >= LONE_BITS else SHORT_CUT


def thresholds(scanned: DataFrame, q: float = 0.1) -> dict[str, float]:
    """The p-value from which a class's strings count as random. Spark counts p in bins by class; the
    counts (classes x bins, some hundred rows at most) are what reaches the driver."""
    each = scanned.select(F.explode("__tested").alias("c")).select("c.label", F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts: dict[str, dict[int, list[int]]] = {}
    for row in each.groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n")).collect():
        encoding, octave = row["label"].split(":")
        counts.setdefault(encoding, {}).setdefault(int(octave), [0] * BINS)[row["bin"]] = row["n"]
    out = {}
    for encoding, of in counts.items():
        for octave in of:
            near = [[n for o, n in of.items() if abs(o - octave) <= width] for width in range(32)]
            pooled = next(([sum(x) for x in zip(*some, strict=True)] for some in near if sum(map(sum, some)) >= MIN_CLASS), None)
            if pooled is None:
                out[f"{encoding}:{octave}"] = lone_cut(encoding, octave)
                continue
            random = 2 * sum(pooled[BINS // 2 :])
            for b in range(BINS):
                kept = sum(pooled[b:])
                if kept and random and 1 - random * (1 - b / BINS) / kept <= q:
                    out[f"{encoding}:{octave}"] = b / BINS
                    break
    return out


def spans_of(found: Column) -> Column:
    """Places with a kind as spans."""
    return F.transform(found, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"))).cast(SPAN)


def with_random(scanned: DataFrame, cuts: dict[str, float]) -> DataFrame:
    """Adds ``__random``: the spans of candidates at or above their class's threshold."""
    if not cuts:
        return scanned.withColumn("__random", F.array().cast(SPAN))
    known = F.create_map(*(F.lit(x) for pair in sorted(cuts.items()) for x in pair))
    hits = F.filter("__tested", lambda c: (c["kind"] == len(KINDS)) & (c["p"] >= F.coalesce(F.try_element_at(known, c["label"]), F.lit(2.0))))
    return scanned.withColumn("__random", spans_of(hits))


def find(docs: DataFrame, q: float = 0.1) -> DataFrame:
    """doc_id, ``base`` and ``spans`` (all; each sorted by start, then kind) of every row, and ``tests``:
    (start, kind, end, encoding, label, p) of every string that was tested, base values included."""
    scanned = checkpointed(scan(docs.select("doc_id", "text")).drop("text"))
    found = with_random(scanned, thresholds(scanned, q))
    base = spans_of(F.col("__base"))
    return found.select("doc_id", base.alias("base"), F.array_sort(F.concat(base, "__random")).alias("spans"), F.col("__tested").alias("tests"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(name) for name, *_ in KINDS), F.lit(RANDOM))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, q: float = 0.1, marker: str = "[SECRET]") -> DataFrame:
    """All columns of ``docs``, with every span in ``text`` replaced by the marker. Overlapping spans
    become one marker. The texts are scanned once for the thresholds and once to be rewritten."""
    cuts = thresholds(checkpointed(scan(docs.select("text")).select("__tested")), q)
    found = with_random(scan(docs), cuts).withColumn("__all", F.array_sort(F.concat(spans_of(F.col("__base")), "__random")))

    def clean(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        each = F.zip_with(spans, running(ends, F.greatest, 0), lambda s, e: F.struct(e.alias("begin"), s["start"].alias("start")))
        return replaced(F.col("text"), F.filter(each, lambda x: x["start"] >= x["begin"]), F.array_max(ends), marker)

    text = F.when(F.size("__all") > 0, let(F.col("__all"), clean)).otherwise(F.col("text"))
    return found.select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns))
