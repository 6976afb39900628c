import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline as C
from mailjobs.llm import nearcopies, quality

from .test_mixing import fill

WORD = re.compile(r"[^\x20\x09-\x0D]+").findall


def test_stages_equal_brute_force(spark, docs, sf, tmp_path):
    import base64

    import numpy as np
    import tiktoken

    out, now = [], docs
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, now, sf).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        out.append(now.collect())
        assert k == len(C.STAGES) - 1 or now.columns == list(C.COLUMNS)

    rows = docs.collect()
    policy = quality.POLICIES["v2"]
    names = list(quality.MEASURES)

    def fails(text):
        m = dict(zip(names, quality.measure(text), strict=True))
        rules = {"few_words": m["n_words"] < 10, "repeated_windows": 100 * m["n_repeat_words"] > 20 * m["n_words"], "symbols": 10 * m["n_symbols"] > m["n_words"], "duplicate_lines": 2 * m["n_dup_lines"] > m["n_lines"], "shouting": 2 * m["n_upper_words"] > m["n_words"], "exclamations": 2 * m["n_exclaim"] > m["n_words"], "short_words": m["word_chars"] < 2 * m["n_words"], "long_words": m["word_chars"] > 15 * m["n_words"]}
        return any(rules[r] for r in policy)

    kept = [r for r in rows if not fails(r["text"])]
    assert sorted(r["doc_id"] for r in out[0]) == sorted(r["doc_id"] for r in kept)

    kept.sort(key=lambda r: r["doc_id"])
    sets = [set(nearcopies.shingles(r["text"]).tolist()) for r in kept]
    label = list(range(len(kept)))
    find = lambda k: k if label[k] == k else find(label[k])
    for i in range(len(kept)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    assert sorted(r["doc_id"] for r in out[1]) == sorted(kept[k]["doc_id"] for k in range(len(kept)) if find(k) == k)

    assert len(out[2]) == len(out[1]) and all(r["n_chars"] == len(r["text"]) for r in out[2])
    before = {r["doc_id"]: r["text"] for r in out[1]}
    for r in out[2]:
        assert not re.search(r"[0-9a-f]{24,}", r["text"])
        if "[SECRET]" not in r["text"]:
            assert r["text"] == before[r["doc_id"]]

    size, taken = defaultdict(int), defaultdict(int)
    for r in out[2]:
        size[r["source"]] += len(WORD(r["text"]))
    for r in out[3]:
        taken[r["source"]] += len(WORD(r["text"]))
    longest = {s: max(len(WORD(r["text"])) for r in out[2] if r["source"] == s) for s in size}
    for s, target in fill(size).items():
        assert abs(taken[s] - target) <= longest[s] / 2 + 1
    cleaned = {r["doc_id"]: r["text"] for r in out[2]}
    assert all(r["text"] == cleaned[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in out[3])
    assert max(Counter(r["doc_id"] for r in out[3]).values()) <= 3

    from mailjobs.llm.queries import BPE_FILE, bpe_pattern, vocabulary

    with open(vocabulary(BPE_FILE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    peer = tiktoken.Encoding("own", pat_str=bpe_pattern(), mergeable_ranks=ranks, special_tokens={})
    mark = lambda doc_id, ids: (doc_id, hashlib.sha256(ids).hexdigest())
    want = sorted(mark(r["doc_id"], np.array(peer.encode_ordinary(r["text"]), dtype="<u4").tobytes()) for r in out[3])
    assert sorted(mark(r["doc_id"], bytes(r["ids"])) for r in out[4]) == want
    assert sorted(mark(r["doc_id"], bytes(r["ids"])) for r in C.run(spark, sf).collect()) == want


def test_each_stage_sees_each_row_once(spark, sf, monkeypatch):
    """Rows that enter the quality rules in one run, counted inside the tasks that measure them."""
    seen = spark.sparkContext.accumulator(0)
    plain = quality.annotate

    def counted(docs, *a, **k):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return plain(docs.mapInArrow(count, docs.schema), *a, **k)

    monkeypatch.setattr(quality, "annotate", counted)
    C.run(spark, sf).count()
    assert seen.value == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_odd_rows(spark, odd, empty, sf):
    """Of the odd documents the rules keep two texts, one of them three times; copies become one row."""
    from pyspark.sql import functions as F

    now = odd.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    ids = []
    for _, stage in C.STAGES:
        now = stage(spark, now, sf)
        ids.append(sorted({r["doc_id"] for r in now.select("doc_id").collect()}, key=lambda k: (k is None, k or 0)))
    assert ids[0] == [1, 2, None] and ids[1:] == [[1, None]] * 4
    now = empty.withColumn("n_chars", F.lit(0).cast("long"))
    for _, stage in C.STAGES:
        now = stage(spark, now, sf)
        assert now.count() == 0
