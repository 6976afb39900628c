"""Schemas of the library's tables and records."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B, D, TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DateType(), T.TimestampType()
HISTORY = T.DecimalType(20, 0)  # an unsigned 64-bit number doesn't fit a long


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TASK = _struct(title=S, description=S, dueDate=S, priority=S)

TABLES: dict[str, T.StructType] = {
    "user": _struct(id=I, email=S, subscription_status=S, last_payment_attempt_at=TS, last_successful_payment_at=TS, created_at=TS, updated_at=TS, is_setup_complete=B, is_initial_scan_complete=B, last_updated_email_rules=TS, daily_token_limit=L),
    # The token columns of this table are left out on purpose: no job needs them.
    "user_account_access": _struct(id=I, expires_at=TS, needs_reauthentication=B, created_at=TS, updated_at=TS, user_email=S),
    "user_token_usage_stat": _struct(id=I, date=D, month=I, year=I, tokens_consumed=L, created_at=TS, updated_at=TS, user_email=S),
    "processed_email": T.StructType(
        [
            *_struct(id=S, user_id=I, processed_at=TS, category=S).fields,
            T.StructField("extracted_tasks", T.ArrayType(TASK)),
            *_struct(due_date=T.TimestampNTZType(), tasks_done=B, ai_answer=S, ai_confidence=S, is_thread=B, has_new_reply=B, thread_id=S, is_read=B, history_id=HISTORY, internal_date=L).fields,
            *[T.StructField(name, S) for name in ("from", "subject", "snippet")],
        ]
    ),
    "user_email_rule": _struct(id=I, user_id=I, description=S, semantic_key=S, name=S, mail_label=S, extract_tasks=B, priority=I, matching_labels=T.ArrayType(S), created_at=TS, updated_at=TS),
    "system_email_rule": _struct(id=I, description=S, semantic_key=S, name=S, mail_label=S, extract_tasks=B, priority=I, created_at=TS, updated_at=TS),
    "auto_cleanup_setting": _struct(id=I, user_id=I, mail_label=S, after_days_old=I, cleanup_action=S, created_at=TS, updated_at=TS),
    "email_embedding": _struct(id=I, email_id=S, user_id=I, chunk_index=I, chunk_text=S, created_at=TS, embedding=T.ArrayType(T.FloatType())),
    "email_training": T.StructType([*_struct(id=I, user_email=S, email_id=S).fields, T.StructField("from", S), *_struct(subject=S, body=S, ai_answer=S, confidence=T.FloatType(), heuristics_used=B).fields]),
    "processed_daily_summary": _struct(id=I, user_id=I, created_at=TS),
}

HEADER = _struct(name=S, value=S)
#: A mail message document: the raw form, and the headers of the parsed form.
MESSAGE = _struct(id=S, threadId=S, labelIds=T.ArrayType(S), historyId=S, internalDate=S, snippet=S, raw=S, payload=_struct(mimeType=S, headers=T.ArrayType(HEADER)))

#: A line of a reply file; the body is JSON text of its own.
RESULT_LINE = _struct(id=S, custom_id=S, response=_struct(status_code=I, body=S), error=_struct(message=S))
#: What is read of a reply's body.
REPLY_BODY = "struct<choices:array<struct<message:struct<content:string>>>,usage:struct<total_tokens:bigint>>"
TASKS = "struct<tasks:array<struct<title:string,description:string,dueDate:string,priority:string>>>"
