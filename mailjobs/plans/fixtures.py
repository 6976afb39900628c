"""The library's tables as views of the test tables: one SQL text for Spark and DuckDB each.

``{BYTES}`` is the number of UTF-8 bytes of ``text``, spelled differently by the two.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
BYTES = {"spark": "octet_length(text)", "duckdb": "octet_length(encode(text))"}

VIEWS: dict[str, str] = {
    "m_user": """select c_custkey as id, lower(c_name) || '@example.com' as email, case c_mktsegment when 'HOUSEHOLD' then 'CANCELLED' when 'MACHINERY' then 'PAST_DUE' when 'FURNITURE' then 'UNPAID' else 'ACTIVE' end as subscription_status, c_custkey % 7 <> 0 as is_initial_scan_complete, cast(300 + c_custkey % 5 * 400 as bigint) as daily_token_limit from customer""",
    "m_access": """select c_custkey as id, lower(c_name) || '@example.com' as user_email, c_custkey % 11 = 0 as needs_reauthentication from customer where c_custkey % 13 <> 0""",
    "m_usage": """select lower(c.c_name) || '@example.com' as user_email, cast(e.ts as date) as date, cast(sum(cast(floor(e.value * 10) as bigint)) as bigint) as tokens_consumed from events e join customer c on c.c_custkey = e.user_id group by 1, 2""",
    "m_system_rule": """select * from (values (1,'1-URGENT','alerts',true,3),(2,'2-HIGH','finances',true,2),(3,'3-MEDIUM','orders',false,1),(4,'5-LOW','newsletters',false,0)) as t(id,semantic_key,mail_label,extract_tasks,priority)""",
    "m_user_rule": """select c_custkey as id, c_custkey as user_id, '1-URGENT' as semantic_key, 'alerts' as mail_label, true as extract_tasks, 4 as priority from customer where c_custkey % 10 = 0""",
    "m_email": """select 'm' || cast(o.o_orderkey as varchar(20)) as id, o.o_custkey as user_id, o.o_orderdate as processed_at, coalesce(r.mail_label,'uncategorized') as category, case when r.mail_label is null then 'Unknown' else o.o_orderpriority end as ai_answer, case when o.o_orderkey % 3 = 0 then d.due end as due_date, o.o_orderkey % 5 = 0 as tasks_done, o.o_orderstatus = 'F' as is_read, o.o_orderkey % 4 = 0 as has_new_reply, cast(o.o_orderkey as decimal(20,0)) as history_id, o.o_orderkey * 60000 as internal_date from orders o left join m_system_rule r on r.semantic_key = o.o_orderpriority left join (select l_orderkey, max(l_shipdate) as due from lineitem group by l_orderkey) d on d.l_orderkey = o.o_orderkey""",
    "m_setting": """select c_custkey as id, c_custkey as user_id, 'newsletters' as mail_label, cast(7 + c_custkey % 3 * 100 as int) as after_days_old, case c_custkey % 3 when 0 then 'DELETE' when 1 then 'ARCHIVE' else 'NOTHING' end as cleanup_action from customer where c_custkey % 2 = 0""",
    "m_reply": """select cast(o_custkey as varchar(20)) || '_m' || cast(o_orderkey as varchar(20)) as custom_id, case when o_orderkey % 19 = 0 then 500 else 200 end as status_code, o_orderkey % 17 = 0 as has_error, 50 + o_orderkey % 50 as total_tokens, case when o_orderkey % 23 = 0 then 'not json' else '{"general_category":' || case when o_orderkey % 2 = 0 then '"Newsletters"' else 'null' end || ',"specific_type":"' || lower(o_orderpriority) || '","confidence":' || case when o_orderkey % 29 = 0 then '"0.9"' else '0.' || lpad(cast(o_orderkey % 100 as varchar(20)), 2, '0') end || '}' end as content from orders""",
    "m_task_reply": """select cast(o_custkey as varchar(20)) || '_m' || cast(o_orderkey as varchar(20)) as custom_id, case o_orderkey % 4 when 0 then '{"tasks":[]}' when 1 then '{"tasks":[{"title":"pay","dueDate":"1998-06-20T09:00:00","priority":"high"},{"title":"call","dueDate":"1998-06-18T09:00:00"}]}' when 2 then '{"tasks":[{"title":"read","dueDate":"1998-06-19"}]}' else '{"tasks":[{"description":"no title"}]}' end as content, 20 + o_orderkey % 30 as total_tokens from orders""",
    "m_message": """select conv_id as thread_id, conv_id * 100 + turn as message_id, role as sender, (conv_id + turn) % 2 = 0 as is_unread, turn from conversations""",
    "m_item": """select case when doc_id % 3 = 0 then 0 else doc_id % 20 end as user_id, 'd' || cast(doc_id as varchar(20)) as email_id, doc_id as arrival, doc_id * 60000 as internal_date, cast({BYTES} as bigint) as n_bytes, doc_id % 6 as stage_no, source as subject, text as body from documents""",
    "m_entry": """select user_id, 'x' || cast(event_id % 5000 as varchar(20)) as email_id, case event_type when 'signup' then 0 when 'view' then 2 else 1 end as priority, event_id as arrival from events""",
    "m_seen": """select 'k' || cast(user_id as varchar(20)) as email_id, ts, event_id from events""",
    "m_alert": """select user_id % 5 as channel, ts, 'event ' || cast(event_id as varchar(20)) as message from events where event_type = 'error'""",
    "m_embedding": """select 'e' || cast(vec_id - vec_id % 3 as varchar(20)) as email_id, label as user_id, cast(vec_id % 3 as int) as chunk_index, case when vec_id % 31 <> 0 then 'chunk ' || cast(vec_id as varchar(20)) end as chunk_text, embedding from embeddings""",
    "m_query": """select vec_id as query_id, label as user_id, embedding from embeddings where vec_id % 50 = 0""",
    "m_centroid": """select 'cat' || cast(vec_id as varchar(20)) as label, embedding from embeddings where vec_id < 4""",
}


def named(sql: str) -> list[str]:
    """The views that a text uses, those it rests on first."""
    out: list[str] = []
    for name in re.findall(r"\bm_\w+", sql):
        if name in VIEWS and name not in out:
            out += [x for x in [*named(VIEWS[name]), name] if x not in out]
    return out


def duckdb(sql: str) -> str:
    """A query over the views as one DuckDB text."""
    views = ", ".join(f"{n} as ({VIEWS[n].replace('{BYTES}', BYTES['duckdb'])})" for n in named(sql))
    if not views:
        return sql
    text = sql.strip()
    for start in ("with recursive ", "with "):
        if text.lower().startswith(start):
            return f"{start}{views}, {text[len(start):]}"
    return f"with {views} {text}"


class Tables:
    """Test tables and views of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = VIEWS[name].replace("{BYTES}", BYTES["spark"])
        for other in dict.fromkeys(re.findall(r"\b\w+\b", text)):
            if other != name and (other in VIEWS or other in BASE):
                self(other).createOrReplaceTempView(other)
        return self.spark.sql(text)
