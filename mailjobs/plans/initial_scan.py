"""The initial scan of mailboxes as one batch job, in two halves around the model call.

``prepare`` ends in request lines; ``finish`` starts from reply lines. Between them the work is outside
of Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import emails as E
from ..operators import metrics as M
from ..operators import rules as D
from ..operators import schedule as W
from ..sources import batches as A
from ..sources.tables import insert_ignore


@dataclass
class Scan:
    """What the missing configuration would hold."""

    now_ms: Column
    now: Column
    days: int
    max_emails: int
    token_limit: int
    threshold: float
    temperature: float
    system_prompt: str
    heuristics: tuple[tuple[str, str, int], ...] = ()


def prepare(messages: DataFrame, processed: DataFrame, scan: Scan) -> DataFrame:
    """custom_id, user_id, email_id, from, subject, body, tokens, request of the emails to classify.

    ``messages``: user_id, email_id, arrival, internal_date, from, subject, body. The newest of each
    mailbox are picked on narrow rows before any text is cleaned; cleaning is narrow, and pruning
    partitions by user once more only if Spark has lost that partitioning.
    """
    slim = messages.select("user_id", F.col("email_id").alias("id"), "internal_date")
    picked = W.latest_ids(slim, processed, scan.now_ms, scan.days, scan.max_emails).select("user_id", F.col("id").alias("email_id"))
    rows = messages.join(picked, ["user_id", "email_id"]).withColumn("body", X.simplify_text(F.col("body")))
    rows = rows.withColumn("tokens", X.estimate_tokens(X.render_message(F.col("subject"), F.col("body"))))
    rows = W.prune_to_token_limit(rows, scan.token_limit)
    custom = X.make_custom_id(F.col("user_id"), F.col("email_id"))
    prompt = X.categorization_prompt(F.col("subject"), F.col("from"), F.col("body"))
    return rows.withColumn("custom_id", custom).withColumn("request", A.request_line(custom, F.lit(scan.system_prompt), prompt, "categorization", scan.temperature))


def finish(prepared: DataFrame, replies: DataFrame, task_replies: DataFrame, rules: DataFrame, processed: DataFrame, scan: Scan) -> DataFrame:
    """The rows to append to processed_email. ``replies`` and ``task_replies``: custom_id, status_code,
    has_error, body."""
    items = prepared.select("custom_id", "user_id", "email_id", "from", "internal_date", "arrival")
    parsed = D.parse_category_results(replies).join(items.select("custom_id", "from"), "custom_id")
    matched = D.match_system_rule(parsed, rules, scan.threshold, scan.heuristics)
    results = matched.select("custom_id", F.col("rule.mail_label").alias("category"), F.col("rule.semantic_key").alias("ai_answer"), "confidence", F.col("rule.extract_tasks").alias("extract_tasks"))
    tasks = D.parse_task_results(task_replies).join(results.where("extract_tasks").select("custom_id"), "custom_id", "left_semi")
    full = E.attach_results(items, results, tasks)
    full = full.withColumns({"label_ids": F.array().cast("array<string>"), "thread_id": F.lit(None).cast("string"), "history_id": F.col("arrival").cast("decimal(20,0)")})
    return insert_ignore(D.build_processed_email(full, scan.now), processed, "id", "user_id", "history_id")


def summary(inserted: DataFrame, rules: DataFrame) -> DataFrame:
    """category, n, priority, and how many tasks and emails with tasks there are in the category."""
    size = F.coalesce(F.size("extracted_tasks"), F.lit(0))
    tasks = inserted.groupBy("category").agg(F.sum(size).cast("long").alias("n_tasks"), F.count_if(size > 0).alias("n_with_tasks"))
    return M.category_summary(inserted, rules).join(tasks, "category")
