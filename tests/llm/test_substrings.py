import pytest

from mailjobs.llm import substrings as U


def brute(rows, min_words=8):
    """First occurrences by (doc_id, start); the merged spans that each document loses."""
    first, lost = {}, {}
    for i, t in sorted(rows):
        for s, e, d in sorted(U.units(t or "", min_words)):
            if first.setdefault(d, (i, s)) != (i, s):
                lost.setdefault(i, set()).add((s, e))
    out = {}
    for i, spans in lost.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        out[i] = merged
    return out


def test_units():
    text = "  One two three four. Five six seven EIGHT nine!\nshort\nOne  two three four. five six seven eight nine!"
    got = {text[s:e]: d for s, e, d in U.units(text, 4)}
    assert set(got) == {"One two three four. Five six seven EIGHT nine!", "One two three four.", "Five six seven EIGHT nine!", "short\nOne  two three four.", "One  two three four. five six seven eight nine!", "One  two three four.", "five six seven eight nine!"}
    assert got["One two three four."] == got["One  two three four."] and got["Five six seven EIGHT nine!"] == got["five six seven eight nine!"]
    assert U.units("", 1) == [] and U.units("a b\n\n", 3) == []


def test_equals_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows)
    assert want
    for r in U.report(docs).collect():
        assert [(s["start"], s["end"]) for s in r["removed"]] == want.get(r["doc_id"], [])


def test_passages_are_caught_and_clean_documents_stay(spark):
    passage = "This passage of words stands in many documents and repeats. " + " ".join(f"word{k}" for k in range(60)) + "."
    rows = [(k, f"Own text of document number {k} with enough words to count here. {passage} And more own text number {k} that nobody else has written.") for k in range(10)]
    rows += [(100 + k, f"A clean document with a number {k} and words of its very own, nothing else {k}.") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in U.report(df).collect()}
    assert got[0]["n_removed"] == 0 and all(got[k]["n_removed_chars"] >= len(passage) - 2 for k in range(1, 10))
    assert all(got[100 + k]["n_removed"] == 0 for k in range(5))
    text = {r["doc_id"]: r["text"] for r in U.removed(df).collect()}
    assert passage in text[0] and "word30" not in text[3] and "Own text of document number 3" in text[3] and "number 3 that nobody" in text[3]


@pytest.mark.parametrize("make", [U.report, U.removed])
def test_odd_rows(odd, empty, make):
    got = make(odd).collect()
    assert len(got) == odd.count()
    cut = {r["doc_id"]: [(s["start"], s["end"]) for s in r["removed"]] for r in got}
    assert cut[1] == [] and cut[2] == [(0, 65)] and len(cut[9]) == 1
    assert make(empty).count() == 0


def test_units_equal_enumeration():
    """Every stretch from a sentence on that first reaches the words, found by trying all ends."""
    text = "A b. C d e!\n\nf\ng h i j k l. M\n n o? P q r s t u v."
    parts = ["A b.", "C d e!", "f", "g h i j k l.", "M", "n o?", "P q r s t u v."]
    at = [text.index(p) for p in parts]
    want = set()
    for i in range(len(parts)):
        for j in range(i, len(parts)):
            if sum(len(p.split()) for p in parts[i : j + 1]) >= 5:
                want.add((at[i], at[j] + len(parts[j])))
                break
    want.add((at[0], at[1] + len(parts[1])))  # the first line
    want |= {(at[3], at[4] + 1), (at[5], at[6] + len(parts[6]))}  # lines of several sentences
    assert {(s, e) for s, e, _ in U.units(text, 5)} == want


def test_passages_of_short_sentences_and_lines_are_caught(spark):
    """Over 50 words in lines and sentences of fewer words than a unit; what little may stay is at the end."""
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = "\n".join(" ".join(word() for _ in range(rng.choice([2, 3, 5]))) + rng.choice([".", "!", ""]) for _ in range(18))
    n = len(passage.split())
    rows = [(k, "\n".join(" ".join(word() for _ in range(9)) + "." for _ in range(3)) + "\n" + passage + "\n" + " ".join(word() for _ in range(40)) + ".") for k in range(6)]
    assert n > 50
    for r in U.removed(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect():
        left = sum(w in r["text"].split() for w in passage.split())
        assert left == n if r["doc_id"] == 0 else left < 16
        assert len(r["text"].split()) == 67 + left


def test_stock_phrases_stay(spark):
    rows = [(k, f"Own words of number {k} stand here alone. All rights are reserved by the owners. Other words {k} follow.") for k in range(50)]
    assert U.report(spark.createDataFrame(rows, "doc_id long, text string"), 16).agg({"n_removed": "sum"}).first()[0] == 0


def test_many_spans_are_merged_in_linear_time(one):
    from pyspark.sql import functions as F

    n = 30_000
    spans = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((k * 10).alias("start"), (k * 10 + F.when(k % 3 == 0, 15).otherwise(5)).alias("end")))
    got = [tuple(s) for s in one(U.merged(spans))]
    assert len(got) == 2 * n // 3 and got[:3] == [(0, 15), (20, 25), (30, 45)] and got[-1] == ((n - 1) * 10, (n - 1) * 10 + 5)
