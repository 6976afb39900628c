"""Queries of the streaming jobs (their batch twins, and micro-batch jobs drained once), messages and
the initial scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import messages as MS
from ..streaming import jobs as J
from ..streaming import ttl as TT
from . import initial_scan as IS
from .registry import THRESHOLD, now, query, shared_folder
from .text_queries import CLEAN_SQL


def drain(t, name: str, shape, job) -> str:
    """Runs a micro-batch job over all of a table as a stream, once, and returns its output folder."""
    spark, out = t.spark, shared_folder(t.spark)
    schema = t(name).schema
    path = f"{t.sf_dir}/{name}.parque[t]"  # a pattern: the table may be a file or a folder
    stream = shape(spark.readStream.schema(schema).parquet(path))
    running = stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(job(out)).start()
    running.awaitTermination()
    return out


@query("a2_read_messages", "select 'm' || doc_id as id, source as thread_id, cast(case when doc_id % 3 = 0 then 0 else doc_id end as bigint) as history_id, doc_id * 1000 as internal_date, case when doc_id % 2 = 0 then 'INBOX,UNREAD' else '' end as labels, length(text) as n_raw from documents")
def _(t):
    """Message documents written as JSON lines, and read with the fixed schema."""
    even = F.col("doc_id") % 2 == 0
    history = F.when(F.col("doc_id") % 3 == 0, "not a number").otherwise(F.col("doc_id").cast("string"))
    message = F.struct(F.concat(F.lit("m"), F.col("doc_id")).alias("id"), F.col("source").alias("threadId"), F.when(even, F.array(F.lit("INBOX"), F.lit("UNREAD"))).alias("labelIds"), history.alias("historyId"), (F.col("doc_id") * 1000).cast("string").alias("internalDate"), F.col("text").alias("raw"))
    out = shared_folder(t.spark)
    t("documents").select(F.to_json(message).alias("value")).write.text(out)
    m = MS.read_messages(t.spark, out)
    return m.select("id", "thread_id", F.col("history_id").cast("long").alias("history_id"), "internal_date", F.array_join("label_ids", ",").alias("labels"), F.length("raw").cast("long").alias("n_raw"))


@query("a3_parse_mime", "select doc_id, 'writer' || doc_id || '@example.com' as from_address, 'Writer <writer' || doc_id || '@example.com>' as from_display, source as subject, text as body, case when doc_id % 10 = 0 then 'no raw message' end as error from documents where doc_id % 10 <> 0 union all select doc_id, null, null, null, null, 'no raw message' from documents where doc_id % 10 = 0")
def _(t):
    head = F.format_string("From: Writer <writer%d@example.com>\r\nSubject: %s\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n", "doc_id", "source")
    mime = F.concat(head, F.base64(F.encode("text", "UTF-8")))
    raw = F.translate(F.regexp_replace(F.base64(F.encode(mime, "UTF-8")), r"\s", ""), "+/", "-_")
    rows = t("documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit(None).cast("string")).otherwise(raw).alias("raw"))
    return MS.parse_mime(rows).select("doc_id", "from_address", "from_display", "subject", "body", "error")


@query("t1_dedup_with_ttl", """with recursive r as (select *, row_number() over (partition by email_id order by ts, event_id) as k, count(*) over (partition by email_id) as n from m_seen),
  w(email_id, k, event_id, last, ok) as (select email_id, k, event_id, ts, true from r where k = 1
    union all select r.email_id, r.k, r.event_id, case when epoch_us(r.ts) - epoch_us(w.last) >= 43200000000 then r.ts else w.last end, epoch_us(r.ts) - epoch_us(w.last) >= 43200000000 from w join r on r.email_id = w.email_id and r.k = w.k + 1)
  select email_id, event_id from w where ok""")
def _(t):
    return TT.dedup_with_ttl(t("m_seen"), ttl=43_200_000_000).select("email_id", "event_id")


#: Seen ids: each of 500 comes again every 500 events. Ids of orders are stored for every second user.
_INGEST = """with recursive c as (select *, row_number() over (partition by id order by ts, arrival) as k from (
    select user_id, 'x' || (event_id % 500) as id, ts, event_id as arrival from events where event_id >= 2000)
    where not (user_id % 2 = 0 and id in (select 'x' || o_orderkey from orders where o_orderkey % 3 = 0))),
  w(id, k, user_id, arrival, last, ok) as (select id, k, user_id, arrival, ts, true from c where k = 1
    union all select c.id, c.k, c.user_id, c.arrival, case when epoch_us(c.ts) - epoch_us(w.last) >= {ttl} then c.ts else w.last end, epoch_us(c.ts) - epoch_us(w.last) >= {ttl} from w join c on c.id = w.id and c.k = w.k + 1)
  select user_id, id, arrival from w where ok""".format(ttl=3 * 86_400_000_000)


def _seen_ids(events: DataFrame) -> DataFrame:
    return events.select("user_id", F.concat(F.lit("x"), (F.col("event_id") % 500).cast("string")).alias("id"), F.col("event_id").alias("internal_date"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("arrival"))


def _stored_ids(t) -> DataFrame:
    ids = t("orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("id"))
    owners = _seen_ids(t("events")).where("user_id % 2 = 0").select("user_id", "id").distinct()
    return owners.join(ids, "id", "left_semi")


@query("t2_ingest_new_ids", _INGEST)
def _(t):
    """The events are seen in four micro-batches, a quarter of their time each."""
    spark, out = t.spark, shared_folder(t.spark)
    events = t("events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(at), F.max(at)).first()
    quarter = F.floor((at - first) * 4 / (last - first + 1))
    for k in range(4):
        events.where(quarter == k).write.mode("append").parquet(f"{out}/seen")
        seen = spark.readStream.schema(events.schema).parquet(f"{out}/seen")
        fresh = J.new_ids_stream(_seen_ids(seen), _stored_ids(t), F.lit(2000 + 86_400_000), 1, ttl=3 * 86_400_000_000)
        write = fresh.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
        write.foreachBatch(J.ingest_new_ids(lambda: _stored_ids(t), f"{out}/new")).start().awaitTermination()
    return spark.read.option("basePath", f"{out}/new").parquet(f"{out}/new/batch=*").select("user_id", "id", "arrival")


@query("t2_new_ids_batch", _INGEST)
def _(t):
    return J.new_ids(_seen_ids(t("events")), _stored_ids(t), F.lit(2000 + 86_400_000), 1, ttl=3 * 86_400_000_000).select("user_id", "id", "arrival")


@query("t3_route_items", "select doc_id, case when doc_id % 11 = 0 then 'failed' when doc_id % 5 = 0 then 'user_defined' when doc_id % 2 = 0 then 'tasks' else 'done' end as stage from documents")
def _(t):
    def shape(s: DataFrame) -> DataFrame:
        of = lambda k: F.col("doc_id") % k == 0
        return s.select("doc_id", (~of(11)).alias("replied"), of(5).alias("second"), of(2).alias("extract_tasks"))

    out = drain(t, "documents", shape, J.route_items)
    return t.spark.read.option("basePath", out).parquet(f"{out}/batch=*").select("doc_id", "stage")


@query("t4_retry_failed", "select event_type as id, cast(user_id as varchar) as stage, count(*) as attempts, case when count(*) > 3 then 'dropped' else 'requeued' end as outcome from events group by 1, 2")
def _(t):
    return J.retry_failed(t("events").select(F.col("event_type").alias("id"), F.col("user_id").cast("string").alias("stage")))


@query("t5_rolling_counts", "select user_id, w as window_start, count(*) as n from (select user_id, unnest(generate_series(time_bucket(interval 1 hour, ts) - interval 23 hour, time_bucket(interval 1 hour, ts), interval 1 hour)) as w from events) group by 1, 2")
def _(t):
    return J.rolling_counts(t("events"))


@query("t6_throughput", "select time_bucket(interval 10 second, ts) as window_start, count(*) as n, count(*) / 10.0::double as per_second from events group by 1")
def _(t):
    return J.throughput(t("events"))


@query("t7_alert_digest", """with recursive a as (select *, row_number() over (partition by channel order by ts, message) as k from m_alert),
  o(channel, k, opened, opens) as (select channel, k, ts, k from a where k = 1
    union all select a.channel, a.k, case when epoch_us(a.ts) - epoch_us(o.opened) > 1000000 then a.ts else o.opened end, case when epoch_us(a.ts) - epoch_us(o.opened) > 1000000 then a.k else o.opens end from o join a on a.channel = o.channel and a.k = o.k + 1),
  g as (select o.channel, o.opened + interval 1 second as closed, count(*) as n, case when count(*) = 1 then min(a.message) else count(*) || ' critical errors:' || chr(10) || chr(10) || string_agg((o.k - o.opens + 1) || '. ' || a.message || chr(10), '' order by o.k) end as text, row_number() over (partition by o.channel order by o.opened) as j
    from o join a using (channel, k) group by o.channel, o.opened),
  s(channel, j, last, sent) as (select channel, j, closed, true from g where j = 1
    union all select g.channel, g.j, case when epoch_us(g.closed) - epoch_us(s.last) >= 7200000000 then g.closed else s.last end, epoch_us(g.closed) - epoch_us(s.last) >= 7200000000 from s join g on g.channel = s.channel and g.j = s.j + 1)
  select channel, closed as closed_at, case when sent then 'sent' else 'held' end as outcome, cast(n as integer) as n, text from g join s using (channel, j)""")
def _(t):
    return TT.alert_digest(t("m_alert")).withColumn("closed_at", F.col("closed_at").cast("timestamp_ntz"))


@query("t8_usage_stream", "select user_id, cast(sum(value_tokens) as bigint) as tokens from (select user_id, event_id % 50 as value_tokens from events) group by 1 having sum(value_tokens) <> 0")
def _(t):
    shape = lambda s: s.select("user_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), (F.col("event_id") % 50).alias("actual_tokens"))
    none = lambda: t("m_email").select("id")
    out = drain(t, "events", shape, lambda out: J.usage_stream(none, out))
    return t.spark.read.parquet(f"{out}/usage").groupBy("user_id").agg(F.sum("tokens").cast("long").alias("tokens"))


def _scan() -> IS.Scan:
    return IS.Scan(now_ms=F.lit(14 * 86_400_000), now=now(), days=14, max_emails=30, token_limit=20_000, threshold=THRESHOLD, temperature=0.0, system_prompt="Sort the mail.")


def _messages(t):
    sender = F.concat(F.lit("writer"), F.col("user_id").cast("string"), F.lit("@example.com"))
    return t("m_item").select("user_id", "email_id", "arrival", "internal_date", sender.alias("from"), "subject", "body")


_PREPARED = f"""(select *, sum(tokens) over (partition by user_id order by internal_date desc, arrival desc rows unbounded preceding) as s from (
  select user_id, email_id, arrival, internal_date, octet_length(encode('<subject>' || subject || '</subject> <body>' || ({CLEAN_SQL}) || '</body>')) // 4 as tokens
  from (select *, body as t, row_number() over (partition by user_id order by internal_date desc, email_id) as r from m_item) where r <= 30))"""


@query("p1_scan_prepare", f"select user_id, email_id, cast(tokens as bigint) as tokens from {_PREPARED} where s <= 20000")
def _(t):
    none = t("m_email").where("false")
    return IS.prepare(_messages(t), none, _scan()).select("user_id", "email_id", "tokens")


@query("p2_scan_summary", f"""select category, count(*) as n, coalesce(max(priority), 0) as priority, cast(sum(case when x and arrival % 4 = 1 then 1 else 0 end) as bigint) as n_tasks, cast(count_if(x and arrival % 4 = 1) as bigint) as n_with_tasks from (
  select p.*, coalesce(r.mail_label, 'uncategorized') as category, r.priority, coalesce(r.extract_tasks, true) as x from {_PREPARED} p left join m_system_rule r on r.id = p.arrival % 6 where s <= 20000) group by 1""")
def _(t):
    """Replies are made from the items themselves: rule number arrival % 6, and a task for each fourth."""
    scan = _scan()
    prepared = IS.prepare(_messages(t), t("m_email").where("false"), scan)
    rules = t("m_system_rule")
    keys = F.element_at(F.array(F.lit("none"), *(F.lit(r["semantic_key"]) for r in rules.orderBy("id").collect()), F.lit("other")), (F.col("arrival") % 6 + 1).cast("int"))
    body = lambda content: F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"), F.struct(F.lit(10).alias("total_tokens")).alias("usage")))
    answer = F.to_json(F.struct(keys.alias("specific_type"), F.lit(0.9).alias("confidence")))
    task = F.when(F.col("arrival") % 4 == 1, F.lit('{"tasks":[{"title":"t"}]}')).otherwise(F.lit('{"tasks":[]}'))
    line = lambda content: prepared.select("custom_id", F.lit(200).alias("status_code"), F.lit(False).alias("has_error"), body(content).alias("body"))
    inserted = IS.finish(prepared, line(answer), line(task), rules, t("m_email").where("false"), scan)
    return IS.summary(inserted, rules)
