"""Streams against their batch twins; shuffled input and other partition counts against the plain run."""

import datetime

import pytest
from pyspark.sql import functions as F

from mailjobs.operators import schedule as W
from mailjobs.sources import messages as MS
from mailjobs.streaming import jobs as J
from mailjobs.streaming import ttl as TT

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def drained(spark, rows, schema, shape, path, parts=3):
    """The appended rows of a stream over files of consecutive rows, then one far later row."""
    step = max(1, -(-len(rows) // parts))
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = shape(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


SEEN = "email_id string, ts timestamp, event_id long"


def test_ttl(spark, tmp_path):
    rows = [("a", at(0), 1), ("a", at(10), 2), ("b", at(20), 3), ("a", at(3599), 4), ("a", at(3600), 5), ("a", at(7199), 6), ("b", at(9000), 7)]
    batch = {r["event_id"] for r in TT.dedup_with_ttl(spark.createDataFrame(rows, SEEN)).collect()}
    assert batch == {1, 3, 5, 7}
    out = drained(spark, rows, SEEN, TT.dedup_stream, tmp_path)
    assert {r["event_id"] for r in out.collect()} == batch


def test_rejected_repeat_does_not_extend(spark):
    rows = [("a", at(0), 1), ("a", at(3000), 2), ("a", at(3700), 3)]
    assert {r["event_id"] for r in TT.dedup_with_ttl(spark.createDataFrame(rows, SEEN)).collect()} == {1, 3}


def test_digest(spark):
    rows = [(1, at(0), "a"), (1, at(1), "b"), (1, at(1.5), "c"), (1, at(7300), "d"), (2, at(5), "x")]
    got = TT.alert_digest(spark.createDataFrame(rows, "channel long, ts timestamp, message string")).orderBy("channel", "closed_at").collect()
    assert [(r["channel"], r["outcome"], r["n"]) for r in got] == [(1, "sent", 2), (1, "held", 1), (1, "sent", 1), (2, "sent", 1)]
    assert got[0]["text"] == "2 critical errors:\n\n1. a\n2. b\n" and got[3]["text"] == "x"


def test_digest_stream_agrees_on_closed_groups(spark, tmp_path):
    schema = "channel long, ts timestamp, message string"
    rows = [(1, at(0), "a"), (1, at(1), "b"), (1, at(100), "c"), (1, at(7300), "d"), (1, at(20000), "e")]
    batch = TT.alert_digest(spark.createDataFrame(rows, schema)).collect()
    out = drained(spark, rows, schema, TT.alert_digest_stream, tmp_path).collect()
    plain = lambda rs: {(r["closed_at"], r["outcome"], r["text"]) for r in rs}
    assert plain(out) <= plain(batch) and len(out) >= 3  # the last group stays open until a later watermark


def test_held_alerts_are_bounded():
    d = TT.Digest(sent=0, opened=0, group=[str(k) for k in range(700)])
    assert d.close()[1] == "held" and len(d.held) == TT.MOST_HELD and d.held[0] == "200"


@pytest.mark.parametrize("job", [J.rolling_counts, J.throughput])
def test_windows_stream(spark, tmp_path, job):
    schema = "user_id long, ts timestamp"
    rows = [(k % 3, at(60 * k)) for k in range(200)] + [(0, at(86400 * 5))]
    batch = job(spark.createDataFrame(rows, schema)).collect()
    out = drained(spark, rows, schema, lambda s: job(s, late="1 minute"), tmp_path).collect()
    closed = [r for r in batch if r["window_start"] < at(86400)]
    assert {tuple(r) for r in out} >= {tuple(r) for r in closed}


def test_cheap_dedup(spark, tmp_path):
    rows = [("a", at(0), 1), ("a", at(1), 2), ("b", at(2), 3)]
    assert drained(spark, rows, SEEN, TT.dedup_stream_cheap, tmp_path).count() == 2


@pytest.mark.parametrize("parts", [1, 7])
def test_order_of_input_does_not_matter(spark, parts):
    rows = spark.range(500).select((F.col("id") % 7).alias("user_id"), F.col("id").alias("arrival"), (F.col("id") * 13 % 101).alias("estimate"), F.lit(900).cast("long").alias("quota"), F.lit(0).cast("long").alias("used"), (F.col("id") % 2).cast("int").alias("priority"))
    shuffled = rows.orderBy(F.rand(parts)).repartition(parts)
    for f in (lambda d: W.admit_mixed(d, "arrival"), lambda d: W.quota_admission(d, "arrival"), lambda d: W.round_robin(d, "arrival")):
        assert sorted(map(tuple, f(rows).collect())) == sorted(map(tuple, f(shuffled).collect()))


def test_one_priority_agrees_with_the_mixed_form(spark):
    rows = spark.range(300).select((F.col("id") % 5).alias("user_id"), F.col("id").alias("arrival"), (F.col("id") * 31 % 97).alias("estimate"), F.lit(700).cast("long").alias("quota"), (F.col("id") % 5 * 100).alias("used"), F.lit(W.HIGH).alias("priority"))
    key = lambda d: {(r["user_id"], r["arrival"]) for r in d.collect()}
    assert key(W.quota_admission(rows, "arrival")) == key(W.admit_mixed(rows, "arrival"))


def test_tasks_order(spark):
    entries = spark.createDataFrame([(1, "e1", 2, 1), (1, "e2", 1, 2), (1, "e3", 0, 3), (1, "e3", 1, 4)], "user_id int, email_id string, priority int, arrival long")
    got = W.task_order(entries).orderBy("priority", "turn", "user_first").collect()
    assert [(r["email_id"], r["priority"]) for r in got] == [("e3", 0), ("e2", 1), ("e1", 2)]


def test_messages(spark, tmp_path):
    import base64
    import json

    raw = base64.urlsafe_b64encode(b"From: A B <a@x.org>\r\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\r\nContent-Type: multipart/alternative; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain\r\n\r\nplain\r\n--q\r\nContent-Type: text/html\r\n\r\n<p>html</p>\r\n--q--\r\n").decode().rstrip("=")
    lines = [{"id": "m1", "threadId": "t", "labelIds": ["INBOX"], "historyId": "18446744073709551615", "internalDate": "5", "raw": raw}, {"id": "m2"}]
    (tmp_path / "m.json").write_text("\n".join(json.dumps(x) for x in lines))
    first, second = MS.parse_mime(MS.read_messages(spark, str(tmp_path / "m.json"))).orderBy("id").collect()
    assert (first["from_address"], first["from_display"], first["subject"], first["body"].strip(), first["html"].strip(), first["error"]) == ("a@x.org", "A B <a@x.org>", "Grüße", "plain", "<p>html</p>", None)
    assert int(first["history_id"]) == 2**64 - 1 and first["internal_date"] == 5
    assert second["error"] == "no raw message" and second["label_ids"] == []


def test_request_and_reply_files(spark, tmp_path):
    from mailjobs.sources import batches as A

    items = spark.createDataFrame([("1_a", "s", "u")], "custom_id string, system string, user string")
    A.write_batch_requests(items, str(tmp_path / "q"), "tasks", 0.0)
    assert '"max_tokens":500' in spark.read.text(str(tmp_path / "q")).first()["value"]
    (tmp_path / "r.jsonl").write_text('{"id":"1","custom_id":"1_a","response":{"status_code":200,"body":"{}"}}\n\n{broken\n')
    assert A.read_batch_results(spark, str(tmp_path / "r.jsonl")).count() == 1


def test_pages_partition_the_feed(spark, sf):
    from mailjobs.operators import feed as G
    from mailjobs.plans.data_queries import ranked
    from mailjobs.plans.fixtures import Tables

    rows = ranked(Tables(spark, sf)).cache()
    user = rows.groupBy("user_id").count().orderBy(F.desc("count")).first()["user_id"]
    whole = [r["id"] for r in rows.where(F.col("user_id") == user).orderBy(F.desc("priority_score"), F.desc("history_id")).collect()]
    seen, cursor = [], None
    while True:
        page = G.feed_page(rows, user, cursor, 3).collect()
        seen += [r["id"] for r in page[:3]]
        if len(page) <= 3:
            break
        cursor = (page[2]["priority_score"], page[2]["history_id"])
    assert seen == whole


@pytest.mark.parametrize("salts", [1, 3, 32])
def test_pruning_in_salted_parts_is_exact(spark, salts):
    rows = spark.range(2000).select((F.col("id") % 3).alias("user_id"), (F.col("id") * 7919 % 997).alias("internal_date"), F.col("id").alias("arrival"), (F.col("id") * 31 % 50).alias("tokens"))
    got = {r["arrival"] for r in W.prune_to_token_limit(rows, 700, salts=salts).collect()}
    want, used = set(), {}
    for r in sorted(rows.collect(), key=lambda r: (-r["internal_date"], -r["arrival"])):
        used[r["user_id"]] = used.get(r["user_id"], 0) + r["tokens"]
        if used[r["user_id"]] <= 700:
            want.add(r["arrival"])
    assert got == want
