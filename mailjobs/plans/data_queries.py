"""Queries of tables, rules, users, emails, feed, usage, metrics, scheduling, threads and vectors."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import replies as C
from ..operators import emails as E
from ..operators import feed as G
from ..operators import metrics as M
from ..operators import rules as D
from ..operators import schedule as W
from ..operators import threads as TH
from ..operators import usage as H
from ..operators import users as U
from ..operators import vectors as V
from ..sources import batches as A
from ..sources import tables as ST
from ..sources import upserts as UP
from ..schemas import TABLES
from .registry import DAY_SQL, NOW_SQL, THRESHOLD, day, now, query, shared_folder

#: Folders of the upserted tables.
UPSERT_BUCKETS = 16

# --- tables and files ---------------------------------------------------------------------------


@query("a1_read_tables", "select user_id, count(*) as n, cast(sum(history_id) as bigint) as h from m_email group by 1")
def _(t):
    """Emails written as the library's table, and read with its schema."""
    out, schema, emails = shared_folder(t.spark), TABLES["processed_email"], t("m_email")
    emails.select(*(F.col(f.name).cast(f.dataType) for f in schema if f.name in emails.columns)).write.parquet(f"{out}/processed_email")
    emails = ST.read_tables(t.spark, out, ["processed_email"])["processed_email"]
    return emails.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("history_id").cast("long").alias("h"))


_BODY = """'{"choices":[{"message":{"content":' || to_json(content) || '}}],"usage":{"total_tokens":' || total_tokens || '}}'"""


def reply_lines(t, name: str = "m_reply"):
    """Reply rows with the JSON body that the service would send."""
    r = t(name)
    body = F.to_json(F.struct(F.array(F.struct(F.struct("content").alias("message"))).alias("choices"), F.struct("total_tokens").alias("usage")))
    for c, v in (("status_code", F.lit(200)), ("has_error", F.lit(False))):
        r = r if c in r.columns else r.withColumn(c, v)
    return r.select("custom_id", "status_code", "has_error", body.alias("body"))


@query("a4_batch_requests", """select email_id, cast(json_object('custom_id', cast(user_id as varchar) || '_' || email_id, 'body', json_object('messages', json_array(json_object('role', 'system', 'content', subject), json_object('role', 'user', 'content', email_id)), 'temperature', 0.5::double, 'max_tokens', 100, 'response_format', json_object('type', 'json_object'))) as varchar) as line from m_item""")
def _(t):
    custom = F.concat_ws("_", F.col("user_id").cast("string"), "email_id")
    return t("m_item").select("email_id", A.request_line(custom, F.col("subject"), F.col("email_id"), "categorization", 0.5).alias("line"))


@query("a5_batch_results", "select custom_id, status_code, cast(total_tokens as bigint) as total_tokens from m_reply where total_tokens % 7 <> 0 and total_tokens % 11 <> 0")
def _(t):
    body = F.struct(F.col("status_code"), F.concat(F.lit('{"usage":{"total_tokens":'), F.col("total_tokens"), F.lit("}}")).alias("body"))
    line = F.to_json(F.struct(F.lit("x").alias("id"), "custom_id", body.alias("response")))
    value = F.when(F.col("total_tokens") % 7 == 0, F.lit("  ")).when(F.col("total_tokens") % 11 == 0, F.substring(line, 1, 20)).otherwise(line)
    rows = A.parse_result_lines(t("m_reply").select(value.alias("value")))
    return rows.select("custom_id", "response.status_code", C.parse_body(F.col("response.body"))["total_tokens"].alias("total_tokens"))


@query("a6_insert_ignore", "select email_id, min(arrival) as arrival from (select 'x' || (event_id % 5000) as email_id, event_id as arrival from events) where email_id not in (select 'x' || (o_orderkey % 3000) from orders) group by 1")
def _(t):
    new = t("m_entry").select("email_id", "arrival")
    there = t("orders").select(F.concat(F.lit("x"), (F.col("o_orderkey") % 3000).cast("string")).alias("email_id"))
    return ST.insert_ignore(new, there, "email_id", "arrival")


@query("a7_rule_config", "select e.category, count(*) as n, max(r.priority) as priority from m_email e join (values ('alerts', '1-URGENT', 3), ('finances', '2-HIGH', 2)) r(mail_label, semantic_key, priority) on r.mail_label = e.category group by 1")
def _(t):
    rules = ST.load_rule_config(t.spark, {"alerts": [("1-URGENT", 3)], "finances": [("2-HIGH", 2)]})
    return t("m_email").join(rules, F.col("category") == F.col("mail_label")).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.max("priority").alias("priority"))


@query("a8_update_by_key", f"select id, user_id, case when user_id % 3 = 0 then true else is_read end as is_read, case when user_id % 3 = 0 and not is_read then {NOW_SQL} else processed_at end as updated_at from m_email")
def _(t):
    rows = t("m_email").select("id", "user_id", "is_read", F.col("processed_at").alias("updated_at"))
    keys = t("m_email").where("user_id % 3 = 0").select("id", "user_id")
    return ST.update_by_key(rows, keys, ["id", "user_id"], "is_read", F.lit(True), now())


@query("a6_append_to_table", "select id, n from (select distinct 'x' || (o_orderkey % 3000) as id, -1::bigint as n from orders union all select 'x' || (event_id % 5000), min(event_id) from events where 'x' || (event_id % 5000) not in (select 'x' || (o_orderkey % 3000) from orders) group by 1)")
def _(t):
    """Insert-ignore into a table in folders by key, twice: the second time changes nothing."""
    path = f"{shared_folder(t.spark)}/table"
    there = t("orders").select(F.concat(F.lit("x"), (F.col("o_orderkey") % 3000).cast("string")).alias("id"), F.lit(-1).cast("long").alias("n")).distinct()
    UP.create(there, path, ["id"], UPSERT_BUCKETS)
    new = t("m_entry").select(F.col("email_id").alias("id"), F.col("arrival").alias("n"))
    for _ in range(2):
        UP.append_new(t.spark, path, new, "id", UPSERT_BUCKETS, "n")
    return t.spark.read.parquet(path).select("id", "n")


@query("a8_update_table", f"select id, user_id, case when user_id % 3 = 0 then true else is_read end as is_read, case when user_id % 3 = 0 and not is_read then {NOW_SQL} else processed_at end as updated_at from m_email")
def _(t):
    path = f"{shared_folder(t.spark)}/table"
    UP.create(t("m_email").select("id", "user_id", "is_read", F.col("processed_at").alias("updated_at")), path, ["id", "user_id"], UPSERT_BUCKETS)
    hits = t("m_email").where("user_id % 3 = 0").select("id", "user_id")
    UP.update_rows(t.spark, path, hits, ["id", "user_id"], UPSERT_BUCKETS, "is_read", F.lit(True), now())
    return t.spark.read.parquet(path).select("id", "user_id", "is_read", "updated_at")


# --- replies and rules --------------------------------------------------------------------------

#: Parsed replies in DuckDB: the JSON type tests are those of the library.
_ANSWER = """(select custom_id, status_code, has_error, total_tokens,
  case when json_valid(content) and json_type(content, '$.specific_type') = 'VARCHAR' and json_type(content, '$.confidence') in ('DOUBLE', 'BIGINT', 'UBIGINT') then content end as j from m_reply)"""
_GOOD = f"""(select custom_id, json_extract_string(j, '$.general_category') as general_category, json_extract_string(j, '$.specific_type') as specific_type,
  cast(json_extract(j, '$.confidence') as float) as confidence, cast(total_tokens as bigint) as total_tokens from {_ANSWER} where j is not null and status_code = 200 and not has_error)"""


@query("c1_parse_category_answer", f"select custom_id, json_extract_string(j, '$.general_category') as general_category, json_extract_string(j, '$.specific_type') as specific_type, round(cast(json_extract(j, '$.confidence') as double), 4) as confidence from {_ANSWER}")
def _(t):
    a = t("m_reply").select("custom_id", C.parse_category_answer(F.col("content")).alias("a"))
    return a.select("custom_id", "a.general_category", "a.specific_type", F.round(F.col("a.confidence").cast("double"), 4).alias("confidence"))


@query("c2_category_results", f"select custom_id, general_category, specific_type, round(confidence::double, 4) as confidence, total_tokens from {_GOOD}")
def _(t):
    return D.parse_category_results(reply_lines(t)).withColumn("confidence", F.round(F.col("confidence").cast("double"), 4))


@query("c3_task_results", "select custom_id, case when content like '%pay%' then 'pay,call' when content like '%read%' then 'read' else '' end as titles, cast(total_tokens as bigint) as total_tokens from m_task_reply where content not like '%no title%'")
def _(t):
    rows = D.parse_task_results(reply_lines(t, "m_task_reply"))
    return rows.select("custom_id", F.array_join(F.transform("tasks", lambda x: x["title"]), ",").alias("titles"), "total_tokens")


@query("c4_next_due_date", "select custom_id, case when content like '%pay%' then timestamp '1998-06-18 09:00:00' end as due, case when content like '%pay%' then timestamp '1998-06-18 09:00:00' when content like '%read%' then timestamp '1998-06-19' end as lenient from m_task_reply")
def _(t):
    tasks = C.parse_tasks(F.col("content"))
    return t("m_task_reply").select("custom_id", C.next_due_date(tasks).alias("due"), C.next_due_date(tasks, True).alias("lenient"))


@query("c5_is_read", "select thread_id, message_id, case when turn % 3 = 0 then true else not is_unread end as is_read from m_message")
def _(t):
    labels = F.when(F.col("turn") % 3 == 0, F.lit(None)).otherwise(F.when(F.col("is_unread"), F.array(F.lit("INBOX"), F.lit("UNREAD"))).otherwise(F.array(F.lit("INBOX"))))
    return t("m_message").select("thread_id", "message_id", C.is_read(labels).alias("is_read"))


def user_rules(t):
    """User rules with the labels they stand beside."""
    listed = F.array(F.lit("orders"), F.when(F.col("id") % 3 == 0, F.lit("newsletters")).otherwise(F.lit("alerts")))
    return t("m_user_rule").withColumn("matching_labels", listed)


@query("c6_label_relevant", "select id, category from m_email where category in ('orders', 'newsletters', 'alerts')")
def _(t):
    return D.is_label_relevant(t("m_email").select("id", F.col("category").alias("mail_label")), user_rules(t)).select("id", F.col("mail_label").alias("category"))


@query("c7_custom_labels", "select distinct 'App/' || category as name from m_email where category not in ('uncategorized', 'orders')")
def _(t):
    labels = t("m_email").select(F.concat(F.lit("App/"), "category").alias("name")).distinct().unionByName(t("m_email").select(F.concat(F.lit("X/"), "category").alias("name")).distinct())
    return D.custom_label_filter(labels, "App/", ("uncategorized", "orders"))


@query("c9_lookback_filter", "select email_id, internal_date from m_item where internal_date >= 30000000 - 86400000 * 0 - 0")
def _(t):
    return E.lookback_filter(t("m_item").select("email_id", "internal_date"), F.lit(30_000_000 + 14 * 86_400_000), 14)


HEURISTICS = [("7", "alerts", 3), ("12", "orders", 1)]
_FROM = "'user' || split_part(custom_id, '_', 1) || '@x.com'"
_D1 = f"""(select g.*, {_FROM} as sender, coalesce(s.semantic_key, l.semantic_key, 'Unknown') as k0, coalesce(s.mail_label, l.mail_label, 'uncategorized') as l0,
  coalesce(s.extract_tasks, l.extract_tasks, true) as x0, coalesce(s.priority, l.priority, 2) as p0, confidence < cast(0.3 as float) as low from {_GOOD} g
  left join m_system_rule s on lower(s.semantic_key) = lower(g.specific_type) left join m_system_rule l on {{general}} and lower(l.mail_label) = lower(g.general_category))"""


def _matched(general: str) -> str:
    return f"""select custom_id, case when low and sender like '%7%' then '7' when low and sender like '%12%' then '12' when low then 'Unknown' else k0 end as semantic_key,
  case when low and sender like '%7%' then 'alerts' when low and sender like '%12%' then 'orders' when low then 'uncategorized' else l0 end as mail_label,
  case when low and (sender like '%7%' or sender like '%12%') then false when low then true else x0 end as extract_tasks,
  low and (sender like '%7%' or sender like '%12%') as heuristics_used from {_D1.format(general=general)}"""


def _replies(t):
    return D.parse_category_results(reply_lines(t)).withColumn("from", F.concat(F.lit("user"), F.element_at(F.split("custom_id", "_"), 1), F.lit("@x.com")))


_SHOW = ("custom_id", "rule.semantic_key", "rule.mail_label", "rule.extract_tasks", "heuristics_used")


@query("d1_match_system_rule", _matched("true"))
def _(t):
    return D.match_system_rule(_replies(t), t("m_system_rule"), THRESHOLD, HEURISTICS).select(*_SHOW)


@query("d3_match_rule_single", _matched("false"))
def _(t):
    return D.match_rule_single(_replies(t), t("m_system_rule"), THRESHOLD, HEURISTICS).select(*_SHOW)


_WITH_USER = f"(select *, cast(split_part(custom_id, '_', 1) as bigint) as user_id from {_GOOD})"


def _of_users(t):
    return D.parse_category_results(reply_lines(t)).withColumn("user_id", F.element_at(F.split("custom_id", "_"), 1).cast("long"))


@query("d2_match_user_rule", f"select custom_id, coalesce(r.semantic_key, 'Unknown') as semantic_key, coalesce(r.mail_label, 'uncategorized') as mail_label, coalesce(r.priority, 2) as priority from {_WITH_USER} g left join m_user_rule r on r.user_id = g.user_id and lower(r.semantic_key) = lower(g.specific_type)")
def _(t):
    return D.match_user_rule(_of_users(t), user_rules(t)).select("custom_id", "rule.semantic_key", "rule.mail_label", "rule.priority")


@query("d4_needs_second_pass", """select e.id, e.category = 'uncategorized' and exists (select 1 from m_user_rule r where r.user_id = e.user_id) as by_unknown,
  e.category is null or e.category = 'uncategorized' or exists (select 1 from m_user_rule r where r.user_id = e.user_id and (e.category = 'orders' or e.category = case when r.id % 3 = 0 then 'newsletters' else 'alerts' end)) as by_labels from m_email e""")
def _(t):
    rows = t("m_email").select("id", "user_id", F.col("category").alias("mail_label"))
    a = D.needs_second_pass(rows, user_rules(t)).withColumnRenamed("second", "by_unknown")
    return D.needs_second_pass(a, user_rules(t), "labels").select("id", "by_unknown", F.col("second").alias("by_labels"))


_TWO = f"""(select custom_id, case when total_tokens % 2 = 0 then 'alerts' else 'orders' end as category, specific_type, confidence, total_tokens,
  total_tokens % 3 = 0 as has_second, cast(case when total_tokens % 6 = 0 then 0.95 else 0.96 end as float) as c2 from {_GOOD})"""


@query("d5_merge_passes", f"select custom_id, case when has_second and c2 > cast(0.95 as float) then 'mine' else category end as category, round(cast(case when has_second and c2 > cast(0.95 as float) then c2 else confidence end as double), 4) as confidence, case when has_second and c2 > cast(0.95 as float) then 'User' else 'System' end as source from {_TWO}")
def _(t):
    g = _of_users(t)
    first = g.select("custom_id", F.when(F.col("total_tokens") % 2 == 0, "alerts").otherwise("orders").alias("category"), F.col("specific_type").alias("ai_answer"), "confidence")
    sure = F.when(F.col("total_tokens") % 6 == 0, F.lit(0.95)).otherwise(F.lit(0.96)).cast("float")
    second = g.where("total_tokens % 3 = 0").select("custom_id", F.lit("mine").alias("category"), F.lit("own").alias("ai_answer"), sure.alias("confidence"))
    return D.merge_passes(first, second, "custom_id").select("custom_id", "category", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), "source")


@query("d6_routes", "select id, case when category = 'orders' then 'failed' when user_id % 5 = 0 then 'user_defined' when is_read then 'tasks' else 'done' end as first, case when category <> 'orders' and user_id % 2 = 0 and not is_read then 'done' else 'tasks' end as second from m_email")
def _(t):
    rows = t("m_email").select("id", (F.col("category") != "orders").alias("replied"), (F.col("user_id") % 5 == 0).alias("second"), F.col("is_read").alias("extract_tasks"), F.when(F.col("user_id") % 2 == 0, F.lit(0.96)).otherwise(F.lit(0.95)).cast("float").alias("confidence"))
    first = D.route_after_first(rows).withColumnRenamed("stage", "first")
    return D.route_after_second(first.drop("second")).select("id", "first", F.col("stage").alias("second"))


_D7 = f"""(select g.*, case when confidence < cast(0.3 as float) then 'uncategorized' else coalesce(s.mail_label, l.mail_label, 'uncategorized') end as label from {_WITH_USER} g
  left join m_system_rule s on lower(s.semantic_key) = lower(g.specific_type) left join m_system_rule l on lower(l.mail_label) = lower(g.general_category))"""


@query("d7_classify_two_pass", f"""select g.custom_id, g.user_id, case when asked and c2 > cast(0.95 as float) then coalesce(r2.mail_label, 'uncategorized') else g.label end as category,
  case when asked and c2 > cast(0.95 as float) then '1-urgent' else specific_type end as ai_answer, case when asked and c2 > cast(0.95 as float) then 'User' else 'System' end as source,
  g.total_tokens + case when asked then 10 else 0 end as tokens
  from (select *, label = 'uncategorized' and user_id in (select user_id from m_user_rule) as asked, cast(case when total_tokens % 2 = 0 then 0.99 else 0.5 end as float) as c2 from {_D7}) g
  left join m_user_rule r2 on r2.user_id = g.user_id and lower(r2.semantic_key) = '1-urgent'""")
def _(t):
    first = _of_users(t)
    second = first.select("custom_id", "user_id", F.lit("1-urgent").alias("specific_type"), F.when(F.col("total_tokens") % 2 == 0, F.lit(0.99)).otherwise(F.lit(0.5)).cast("float").alias("confidence"), F.lit(10).cast("long").alias("total_tokens"))
    return D.classify_two_pass(first, second, t("m_system_rule"), user_rules(t), THRESHOLD).select("custom_id", "user_id", "category", "ai_answer", "source", "tokens")


@query("d8_build_processed_email", f"""select custom_id as id, coalesce(case when total_tokens % 2 = 0 then 'alerts' end, 'uncategorized') as category, case when content like '%pay%' then 2 when content like '%read%' then 1 end as n_tasks,
  case when content like '%pay%' then timestamp '1998-06-18 09:00:00' end as due_date, case when total_tokens % 2 = 0 then '0.5' else '0.0' end as ai_confidence, total_tokens % 5 <> 0 as is_read, false as has_new_reply, {NOW_SQL} as processed_at from m_task_reply where content not like '%no title%'""")
def _(t):
    rows = D.parse_task_results(reply_lines(t, "m_task_reply"))
    even = F.col("total_tokens") % 2 == 0
    items = rows.select(F.col("custom_id").alias("email_id"), F.lit(1).alias("user_id"), F.when(even, "alerts").alias("category"), F.lit(None).cast("string").alias("ai_answer"), F.when(even, F.lit(0.5).cast("float")).alias("confidence"), "tasks", F.when(F.col("total_tokens") % 5 == 0, F.array(F.lit("UNREAD"))).alias("label_ids"), F.lit("t").alias("thread_id"), F.lit(1).cast("decimal(20,0)").alias("history_id"), F.lit(1).cast("long").alias("internal_date"))
    return D.build_processed_email(items, now()).select("id", "category", F.when(F.col("extracted_tasks").isNotNull(), F.size("extracted_tasks")).alias("n_tasks"), "due_date", "ai_confidence", "is_read", "has_new_reply", "processed_at")


@query("d9_sync_rules", "select user_id, semantic_key, mail_label, case when user_id % 50 = 0 then 9 else priority end as priority from m_user_rule where (select count(*) from m_user_rule where user_id % 50 = 0) > 0 union all select user_id, semantic_key, mail_label, priority from m_user_rule where (select count(*) from m_user_rule where user_id % 50 = 0) = 0")
def _(t):
    config = t("m_user_rule").withColumn("priority", F.when(F.col("user_id") % 50 == 0, 9).otherwise(F.col("priority")))
    rows, _ = D.sync_rules(t("m_user_rule"), config)
    return rows.select("user_id", "semantic_key", "mail_label", "priority")


@query("d10_rule_taxonomy", """select category as mail_label, '• "' || category || '"' || chr(10) || string_agg('  • "' || ai_answer || '"', chr(10) order by ai_answer) as taxonomy from (select distinct category, ai_answer from m_email) group by 1""")
def _(t):
    return D.rule_taxonomy(t("m_email").select(F.col("category").alias("mail_label"), F.col("ai_answer").alias("semantic_key")))


@query("d11_label_priorities", "select category as mail_label, max_by(user_id % 7, history_id) as priority from m_email group by 1")
def _(t):
    return D.label_priorities(t("m_email").select(F.col("category").alias("mail_label"), (F.col("user_id") % 7).alias("priority"), F.col("history_id").alias("id")))


@query("d12_users_with_rules", "select u.id, u.email, r.priority, coalesce(case when r.user_id is not null then timestamp '2020-01-01' + to_days(cast(r.user_id % 30 as integer)) end, timestamp '0001-01-01')::varchar as last_updated from m_user u left join m_user_rule r on r.user_id = u.id")
def _(t):
    users, rules = t("m_user"), t("m_user_rule").withColumn("updated_at", F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(cast(user_id % 30 as int))"))
    owners = D.users_with_rules(users, rules).select("id").withColumn("owner", F.lit(True))
    own = D.rules_for(users, rules).select(F.col("user_id").alias("id"), "priority")
    return users.select("id", "email").join(owners, "id", "left").join(own, "id", "left").join(D.rules_last_updated(users, rules), "id").select("id", "email", "priority", F.col("last_updated").cast("string").alias("last_updated"))


@query("d13_evaluate_rule", f"select case when specific_type = '1-urgent' then 'success' else 'failure' end as outcome, count(*) as n from {_GOOD} group by 1")
def _(t):
    return D.evaluate_rule(_of_users(t), "1-urgent").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# --- users and emails ---------------------------------------------------------------------------

_UA = "(select u.*, a.needs_reauthentication from m_user u join m_access a on a.user_email = u.email)"


@query("f1_users_with_access", f"select * from {_UA}")
def _(t):
    return U.users_with_access(t("m_user"), t("m_access"))


@query("f2_users_with_usage", f"select u.*, cast(s.date as varchar) as date, s.tokens_consumed from {_UA} u join m_usage s on s.user_email = u.email")
def _(t):
    return U.users_with_access_and_usage(t("m_user"), t("m_access"), t("m_usage")).withColumn("date", F.col("date").cast("string"))


@query("f3_active_users", f"select * from {_UA} where subscription_status = 'ACTIVE' and not needs_reauthentication")
def _(t):
    return U.active_users(t("m_user"), t("m_access"))


_DAY_USE = f"(select user_email, cast(sum(tokens_consumed) as bigint) as t from m_usage where date = {DAY_SQL} group by 1)"


@query("f4_pollable_users", f"select u.*, coalesce(s.t, 0) as tokens_consumed from {_UA} u left join {_DAY_USE} s on s.user_email = u.email where subscription_status = 'ACTIVE' and not needs_reauthentication and is_initial_scan_complete and coalesce(s.t, 0) < daily_token_limit")
def _(t):
    return U.pollable_users(t("m_user"), t("m_access"), t("m_usage"), day())


@query("f5_cancelled_users", "select * from m_user where subscription_status = 'CANCELLED'")
def _(t):
    return U.cancelled_users(t("m_user"))


@query("f6_quota_status", f"""select u.id, coalesce(s.t, 0) as tokens_consumed, case when coalesce(s.t, 0) >= daily_token_limit + daily_token_limit // 25 then 'quota'
  when coalesce(s.t, 0) + coalesce(p.tokens, 0) >= daily_token_limit + daily_token_limit // 25 then 'pipeline_quota' else 'poll' end as status
  from m_user u left join {_DAY_USE} s on s.user_email = u.email left join (select user_id, sum(n_bytes // 4) as tokens from m_item where stage_no between 1 and 4 group by 1) p on p.user_id = u.id""")
def _(t):
    users = U.with_usage(t("m_user"), t("m_usage"), day())
    return U.quota_status(users, M.pipeline_tokens_by_user(items(t))).select("id", "tokens_consumed", "status")


def _ids(t):
    return t("m_email").select("user_id", "id").unionByName(t("m_email").select("user_id", F.concat("id", F.lit("n")).alias("id")))


@query("f7_existing_ids", "select user_id, id from m_email where history_id % 2 = 0")
def _(t):
    return E.existing_ids(_ids(t), t("m_email").where("history_id % 2 = 0"))


@query("f8_unprocessed_ids", "select user_id, id from m_email where history_id % 2 = 1 union all select user_id, id || 'n' from m_email")
def _(t):
    return E.unprocessed_ids(_ids(t), t("m_email").where("history_id % 2 = 0"))


@query("f9_active_cleanup_settings", "select s.* from m_setting s join m_user u on u.id = s.user_id where u.subscription_status = 'ACTIVE'")
def _(t):
    return E.active_cleanup_settings(t("m_setting"), t("m_user")).select("id", "user_id", "mail_label", "after_days_old", "cleanup_action")


_CAND = f"(select e.id, e.user_id, s.mail_label, s.cleanup_action from m_email e join m_setting s on s.user_id = e.user_id and s.mail_label = e.category where e.processed_at < {NOW_SQL} - to_days(s.after_days_old))"


@query("f10_cleanup_candidates", f"select * from {_CAND}")
def _(t):
    return E.cleanup_candidates(t("m_email"), t("m_setting"), now())


@query("f11_cleanup_plan", f"select * from {_CAND} where cleanup_action <> 'NOTHING' and id not in (select id from m_email where is_read)")
def _(t):
    return E.cleanup_plan(E.cleanup_candidates(t("m_email"), t("m_setting"), now()), t("m_email").where("is_read"))


@query("f12_emails_needing_tasks", "select id, user_id from m_email where ai_answer in ('1-URGENT', '2-HIGH')")
def _(t):
    rules = t("m_system_rule").select(F.col("semantic_key").alias("ai_answer"), "extract_tasks")
    results = t("m_email").join(F.broadcast(rules), "ai_answer").select("id", "extract_tasks")
    return E.emails_needing_tasks(t("m_email").select("id", "user_id"), results)


@query("f13_attach_results", f"select o.custom_id, g.specific_type, cast(case when k.content like '%pay%' then 2 when k.content like '%read%' then 1 else 0 end as integer) as n_tasks from (select distinct custom_id from m_reply) o join {_GOOD} g using (custom_id) left join m_task_reply k on k.custom_id = o.custom_id and k.content not like '%no title%'")
def _(t):
    tasks = D.parse_task_results(reply_lines(t, "m_task_reply"))
    results = D.parse_category_results(reply_lines(t)).select("custom_id", "specific_type")
    return E.attach_results(t("m_reply").select("custom_id"), results, tasks).select("custom_id", "specific_type", F.size("tasks").alias("n_tasks"))


@query("f14_emails_by_user", "select id, category from m_email where user_id = 7")
def _(t):
    return E.emails_by_user(t("m_email"), 7).select("id", "category")


# --- feed ---------------------------------------------------------------------------------------

_SCORE = f"""(select e.*, coalesce(u.priority, s.priority) as priority, cast(floor(
  case when due_date is null or tasks_done then 0.0::double when due_date >= {NOW_SQL} + interval 7 day then 200 when due_date >= {NOW_SQL} then 300 - (epoch_us(due_date) - epoch_us({NOW_SQL}))::double / 86400000000.0::double * 100 / 7
    when due_date >= {NOW_SQL} - interval 7 day then 300 else 0 end
  + case when is_read then -90 else 0 end + case when has_new_reply then 200 else 0 end + coalesce(u.priority, s.priority, 2) * 100 + 0.5) as integer) as priority_score
  from m_email e left join m_user_rule u on u.semantic_key = e.ai_answer and u.mail_label = e.category and u.user_id = e.user_id left join m_system_rule s on s.semantic_key = e.ai_answer and s.mail_label = e.category)"""


def ranked(t):
    return G.rank_feed(t("m_email"), t("m_user_rule"), t("m_system_rule"), now())


@query("g1_priority_score", f"select id, priority_score from {_SCORE}")
def _(t):
    return ranked(t).select("id", "priority_score")


@query("g2_rank_feed", f"select id, user_id, priority, priority_score, cast(history_id as bigint) as history_id from {_SCORE}")
def _(t):
    return ranked(t).select("id", "user_id", "priority", "priority_score", F.col("history_id").cast("long").alias("history_id"))


@query("g3_feed_page", f"select id, priority_score from {_SCORE} where user_id = 7 and (priority_score < 310 or (priority_score = 310 and history_id < 9000)) order by priority_score desc, history_id desc limit 21")
def _(t):
    return G.feed_page(ranked(t), 7, (310, 9000)).select("id", "priority_score")


@query("g4_feed_all_users", f"select user_id, cast(r as integer) as position, id, category, ai_answer, priority, priority_score from (select *, row_number() over (partition by user_id order by priority_score desc, history_id desc, id) as r from {_SCORE}) where r <= 20")
def _(t):
    return G.feed_all_users(ranked(t)).select("user_id", "position", "id", "category", "ai_answer", "priority", "priority_score")


@query("g5_latest_ids", "select user_id, id, cast(r as integer) as position from (select user_id, id, row_number() over (partition by user_id order by internal_date desc, id) as r from m_email where history_id % 2 = 1 and internal_date >= 300000000) where r <= 3")
def _(t):
    out = W.latest_ids(t("m_email"), t("m_email").where("history_id % 2 = 0"), F.lit(300_000_000 + 14 * 86_400_000), 14, 3)
    return out.select("user_id", "id", "position")


# --- vectors ------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(cast({a} as double[]), cast({b} as double[]))"


@query("v1_cosine_similarity", f"select a.vec_id, round({_COS.format(a='a.embedding', b='b.embedding')}, 4) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def _(t):
    e = t("embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(V.cosine_similarity(F.col("embedding"), F.col("other")), 4).alias("similarity"))


@query("v2_search_embeddings", f"""select query_id, email_id, best_similarity, position from (select *, cast(row_number() over (partition by query_id order by b desc, email_id) as integer) as position from (
  select query_id, email_id, max(s) as b, round(max(s), 4) as best_similarity from (select *, row_number() over (partition by query_id order by s desc, email_id, chunk_index) as r from (
    select q.query_id, e.email_id, e.chunk_index, e.chunk_text, {_COS.format(a='e.embedding', b='q.embedding')} as s from m_embedding e join m_query q on q.user_id = e.user_id) where s >= 0.1) where r <= 30 and chunk_text is not null group by 1, 2)) where position <= 10""")
def _(t):
    return V.search_embeddings(t("m_embedding"), t("m_query"), 10, 0.1).select("query_id", "email_id", F.round("best_similarity", 4).alias("best_similarity"), "position")


@query("v3_pairwise_similarity", f"select a.email_id, a.chunk_index as a, b.chunk_index as b, round(s, 4) as similarity, case when s >= 0.7 then 'HIGH' when s >= 0.4 then 'AVERAGE' when s >= 0.2 then 'LOW' else 'DISSIMILAR' end as label from m_embedding a join m_embedding b on a.email_id = b.email_id and a.chunk_index < b.chunk_index, lateral (select {_COS.format(a='a.embedding', b='b.embedding')} as s)")
def _(t):
    return V.pairwise_similarity(t("m_embedding"), "email_id", "chunk_index").withColumn("similarity", F.round("similarity", 4))


@query("v3_mean_similarity", f"select a.user_id, (select count(*) from m_embedding n where n.user_id = a.user_id) as n, round(avg({_COS.format(a='a.embedding', b='b.embedding')}), 4) as mean_similarity from (select row_number() over (order by email_id, chunk_index) as k, * from m_embedding) a join (select row_number() over (order by email_id, chunk_index) as k, * from m_embedding) b on a.user_id = b.user_id and a.k < b.k group by 1")
def _(t):
    return V.mean_similarity(t("m_embedding"), "user_id").withColumn("mean_similarity", F.round("mean_similarity", 4))


@query("v4_classify_by_centroid", f"""select email_id, chunk_index, case when s[1].s >= 0.1 and s[1].s - s[2].s >= 0.05 then s[1].label else 'uncategorized' end as label, round(s[1].s, 4) as score from (
  select e.email_id, e.chunk_index, list({{'s': {_COS.format(a='e.embedding', b='c.embedding')}, 'label': c.label}} order by {_COS.format(a='e.embedding', b='c.embedding')} desc) as s from m_embedding e, m_centroid c group by 1, 2)""")
def _(t):
    return V.classify_by_centroid(t("m_embedding"), t("m_centroid"), 0.1).select("email_id", "chunk_index", "label", F.round("score", 4).alias("score"))


# --- usage, metrics, scheduling, threads --------------------------------------------------------


def items(t):
    """Items with their stage and token columns."""
    stage = F.element_at(F.array(*map(F.lit, M.STAGES)), (F.col("stage_no") + 1).cast("int"))
    tokens = F.floor(F.col("n_bytes") / 4)
    return t("m_item").select("user_id", "email_id", "arrival", "internal_date", stage.alias("stage"), tokens.alias("estimated_tokens"), F.lit(500).alias("prompt_tokens"), F.when(F.col("stage_no") == 4, tokens + 400).otherwise(0).alias("actual_tokens"))


_STAGE = "['pending','main','user_defined','tasks','done','failed'][stage_no + 1]"
_ITEM = f"(select *, {_STAGE} as stage, n_bytes // 4 as est, case when stage_no = 4 then n_bytes // 4 + 400 else 0 end as act from m_item)"


@query("h1_usage_today", f"select u.email, coalesce(s.t, 0) as tokens_consumed from m_user u left join {_DAY_USE} s on s.user_email = u.email")
def _(t):
    return H.usage_today(t("m_user"), t("m_usage"), day())


@query("h2_usage_this_month", "select u.email, cast(coalesce(sum(s.tokens_consumed), 0) as bigint) as tokens_consumed from m_user u left join m_usage s on s.user_email = u.email and s.date >= date '2024-01-01' and s.date < date '2024-02-01' group by 1")
def _(t):
    return H.usage_this_month(t("m_user"), t("m_usage"), 2024, 1)


@query("h3_add_usage", f"select user_email, cast({DAY_SQL} as varchar) as date, 2024 as year, 1 as month, cast(sum(x) as bigint) as tokens_consumed from (select user_email, tokens_consumed as x from m_usage where date = {DAY_SQL} union all select email, id % 100 from m_user where id % 3 = 0) group by 1")
def _(t):
    return H.add_usage(t("m_usage"), t("m_user").where("id % 3 = 0").select(F.col("email").alias("user_email"), (F.col("id") % 100).alias("tokens")), day()).withColumn("date", F.col("date").cast("string"))


@query("h3_usage_table", f"select user_email, cast(date as varchar) as date, cast(sum(x) as bigint) as tokens_consumed from (select user_email, date, tokens_consumed as x from m_usage union all select email, {DAY_SQL}, id % 100 from m_user where id % 3 = 0) group by 1, 2")
def _(t):
    """Usage in folders by day and user; the same batch twice counts once."""
    path = f"{shared_folder(t.spark)}/table"
    UP.create(t("m_usage").select("user_email", "tokens_consumed", F.lit(None).cast("long").alias("batch_id"), "date"), path, ["user_email"], 2, "date")
    deltas = t("m_user").where("id % 3 = 0").select(F.col("email").alias("user_email"), (F.col("id") % 100).alias("tokens"))
    for _ in range(2):
        UP.add_tokens(t.spark, path, deltas, day(), 0, 2)
    return t.spark.read.parquet(path).select("user_email", F.col("date").cast("string").alias("date"), "tokens_consumed")


@query("h4_tokens_by_user", f"select user_id, cast(sum(act) as bigint) as tokens from {_ITEM} group by 1 having sum(act) <> 0")
def _(t):
    return H.tokens_by_user(items(t))


@query("h5_pipeline_tokens", f"select user_id, cast(sum(est) as bigint) as tokens from {_ITEM} where stage_no between 1 and 4 group by 1 union all select -1, cast(sum(est) as bigint) from {_ITEM} where stage_no between 1 and 4")
def _(t):
    return M.pipeline_tokens_by_user(items(t)).unionByName(M.pipeline_tokens_total(items(t)).select(F.lit(-1).cast("long").alias("user_id"), "tokens"))


@query("h6_queue_counts", f"select count_if(stage_no = 0)::bigint as pending, count_if(stage_no = 1)::bigint as main, count_if(stage_no = 2)::bigint as user_defined, count_if(stage_no = 3)::bigint as tasks, count_if(stage_no = 4)::bigint as done, count_if(stage_no = 5)::bigint as failed, count(distinct case when stage_no = 0 then user_id end) as pending_users, count_if(stage_no between 1 and 4)::bigint as in_pipeline, cast(sum(case when stage_no between 1 and 4 then est end) as bigint) as total_tokens, (select count(*) from m_email) as recently_processed from {_ITEM}")
def _(t):
    return M.queue_counts(items(t), t("m_email"))


@query("h7_category_summary", "select e.category, count(*) as n, coalesce(max(r.priority), 0) as priority from m_email e left join m_system_rule r on r.mail_label = e.category group by 1")
def _(t):
    return M.category_summary(t("m_email"), t("m_system_rule"))


@query("h8_task_metrics", "select cast(sum(case when content like '%pay%' then 2 when content like '%read%' then 1 else 0 end) as bigint) as n_tasks, count_if(content like '%pay%' or content like '%read%')::bigint as n_emails from m_task_reply")
def _(t):
    return M.task_metrics(t("m_task_reply").select(C.parse_tasks(F.col("content")).alias("extracted_tasks")))


@query("h9_processed_by_user", f"select user_id, count(*) as n from {_ITEM} where stage = 'done' group by 1")
def _(t):
    return M.processed_by_user(items(t).where("stage = 'done'"))


@query("h10_stage_token_report", f"select stage, count(*) as n, cast(sum(est + 500) as bigint) as estimated, cast(sum(act) as bigint) as actual, cast(sum(act) - sum(est + 500) as bigint) as difference from {_ITEM} group by 1")
def _(t):
    return M.stage_token_report(items(t))


@query("h11_scan_progress", "select user_id, count(*) as total, count_if(stage_no > 0)::bigint as fetched, count_if(stage_no >= 4)::bigint as processed, round(count_if(stage_no >= 4) * 100.0::double / count(*), 4) as percentage from m_item group by 1")
def _(t):
    rows = t("m_item").select("user_id", (F.col("stage_no") > 0).alias("fetched"), (F.col("stage_no") >= 4).alias("processed"))
    return M.scan_progress(rows).withColumn("percentage", F.round("percentage", 4))


@query("w1_rolling_user_count", "select event_id, cast(sum(event_id % 5) over (partition by user_id order by ts range between interval 24 hour preceding and current row) as bigint) as rolling_count from events")
def _(t):
    rows = t("events").select("user_id", "ts", "event_id", (F.col("event_id") % 5).alias("n"))
    return M.rolling_user_count(rows).select("event_id", "rolling_count")


@query("w2_rolling_rate", """select event_id, round(case when n < 2 or sec < 0.1 then 0.0 else (hi - lo) / sec end, 4) as rate from (select event_id, count(*) over w as n, (epoch_us(max(ts) over w) - epoch_us(min(ts) over w)) / 1e6 as sec, max(c) over w as hi, min(c) over w as lo
  from (select *, sum(event_id % 5 + 1) over (partition by event_type order by ts, event_id rows unbounded preceding)::double as c from events) window w as (partition by event_type order by ts range between interval 1 hour preceding and current row))""")
def _(t):
    rows = t("events").select("event_type", "ts", "event_id", (F.col("event_id") % 5 + 1).alias("n"))
    return M.rolling_rate(rows, 3_600_000_000, "event_type").select("event_id", F.round("rate", 4).alias("rate"))


@query("w3_prune_to_token_limit", "select user_id, email_id from (select *, sum(n_bytes // 4) over (partition by user_id order by internal_date desc, arrival desc rows unbounded preceding) as s from m_item) where s <= 20000")
def _(t):
    return W.prune_to_token_limit(items(t).withColumnRenamed("estimated_tokens", "tokens"), 20_000).select("user_id", "email_id")


@query("w3_pruned_empty", "select user_id from (select user_id, max_by(n_bytes // 4, internal_date) as t from m_item group by 1) where t > 500")
def _(t):
    return W.pruned_empty(items(t).withColumnRenamed("estimated_tokens", "tokens"), 500)


@query("w4_round_robin", "select email_id, user_id, cast(row_number() over (partition by user_id order by arrival) as integer) as turn from m_item")
def _(t):
    return W.round_robin(t("m_item").select("user_id", "email_id", "arrival"), "arrival").select("email_id", "user_id", "turn")


_ENTRY = "(select user_id, email_id, priority, arrival from (select *, row_number() over (partition by email_id order by arrival) as r from m_entry where priority < 2) where r = 1 union all select user_id, email_id, priority, arrival from m_entry where priority = 2)"


@query("w5_task_order", f"select arrival, priority, cast(row_number() over (partition by priority, user_id order by arrival) as integer) as turn, min(arrival) over (partition by priority, user_id) as user_first from {_ENTRY}")
def _(t):
    return W.task_order(t("m_entry")).select("arrival", "priority", "turn", "user_first")


@query("w6_queue_count_by_user", "select user_id, count_if(priority = 0)::bigint as high, count_if(priority = 1)::bigint as low, count_if(priority = 2)::bigint as background, count(*) as total, count_if(priority < 2)::bigint as categorization from m_entry group by 1")
def _(t):
    return W.queue_count_by_user(t("m_entry"))


_OTHER = "sum(case when {c} then 1 else 0 end) over (partition by thread_id) - case when {c} then 1 else 0 end > 0"


@query("w7_thread_flags", f"select message_id, count(*) over (partition by thread_id) > 1 as is_thread, {_OTHER.format(c='is_unread')} as has_unread_reply, {_OTHER.format(c=chr(115) + 'ender = ' + repr('user'))} as user_has_replied, ({_OTHER.format(c='is_unread')}) and ({_OTHER.format(c='sender = ' + repr('user'))}) as new_reply from m_message")
def _(t):
    return TH.thread_flags(t("m_message"), F.lit("user")).select("message_id", "is_thread", "has_unread_reply", "user_has_replied", "new_reply")


@query("w8_has_new_reply", f"select message_id, is_unread and count(*) over (partition by thread_id) > 1 and ({_OTHER.format(c='(is_unread and sender <> ' + repr('user') + ')')}) as has_new_reply from m_message")
def _(t):
    return TH.has_new_reply(t("m_message"), F.lit("user")).select("message_id", "has_new_reply")


@query("w9_quota_admission", """select user_id, email_id from (select *, max(case when b >= 60000 or e > 60000 - b + 600 then 1 else 0 end) over (partition by user_id order by arrival rows unbounded preceding) as stop from (
  select user_id, email_id, arrival, n_bytes // 4 as e, user_id * 100 + coalesce(sum(n_bytes // 4) over (partition by user_id order by arrival rows between unbounded preceding and 1 preceding), 0) as b from m_item)) where stop = 0""")
def _(t):
    rows = items(t).select("user_id", "email_id", "arrival", F.col("estimated_tokens").alias("estimate"), F.lit(60_000).alias("quota"), (F.col("user_id") * 100).alias("used"))
    return W.quota_admission(rows, "arrival").select("user_id", "email_id")


@query("w9_admit_mixed", """with recursive r as (select user_id, arrival, n_bytes // 4 as e, arrival % 2 as priority, user_id * 100 as used, row_number() over (partition by user_id order by arrival) as k from m_item),
  w(user_id, k, arrival, used, stopped, ok) as (select user_id, 0::bigint, null::bigint, min(used), false, false from r group by user_id
    union all select user_id, k, arrival, case when ok then used + e else used end, stopped or over, ok from (
      select *, not stopped and not over and not low as ok from (
        select r.user_id, r.k, r.arrival, r.e, w.used, w.stopped, r.priority = 1 and w.used > 30000 as low, w.used >= 60000 or (not (r.priority = 1 and w.used > 30000) and r.e > 60000 - w.used + 600) as over
        from w join r on r.user_id = w.user_id and r.k = w.k + 1)))
  select user_id, arrival from w where ok""")
def _(t):
    rows = items(t).select("user_id", "arrival", F.col("estimated_tokens").alias("estimate"), F.lit(60_000).cast("long").alias("quota"), (F.col("user_id") * 100).alias("used"), (F.col("arrival") % 2).cast("int").alias("priority"))
    return W.admit_mixed(rows, "arrival").select("user_id", "arrival")


@query("u1_union_queues", "select email_id, case stage_no when 0 then 'pending' when 1 then 'main' when 2 then 'user_defined' when 3 then 'tasks' when 4 then 'done' else 'failed' end as stage from m_item")
def _(t):
    """All six working queues."""
    names = ("pending", "main", "user_defined", "tasks", "done", "failed")
    return W.union_queues(**{name: t("m_item").where(F.col("stage_no") == k).select("email_id") for k, name in enumerate(names)})


@query("u2_distinct_users", "select distinct user_id from m_item")
def _(t):
    return W.distinct_users(t("m_item"))


@query("u3_rules_differ", "select user_id, bool_or(c) as differ, bool_or(bool_or(c)) over () as any_differ from (select user_id, user_id % 30 = 0 as c from m_user_rule union all select id, true from m_user where id % 30 = 5) group by 1")
def _(t):
    """Users' rules before and after: every third user of them has a raised priority, some have new rules."""
    before = t("m_user_rule")
    raised = before.withColumn("priority", F.when(F.col("user_id") % 30 == 0, F.col("priority") + 1).otherwise(F.col("priority")))
    new = t("m_user").where("id % 30 = 5").select(F.col("id").alias("user_id"), F.lit("2-HIGH").alias("semantic_key"), F.lit("finances").alias("mail_label"), F.lit(True).alias("extract_tasks"), F.lit(1).alias("priority"))
    after = raised.select(*new.columns).unionByName(new)
    return D.changed_rules(before, after).withColumn("any_differ", F.lit(D.rules_differ(before, after)))
