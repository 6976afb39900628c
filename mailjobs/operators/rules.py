"""Replies meet rules: matching, routing, merging, and the rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import is_read, next_due_date, once, parse_body, parse_category_answer, parse_tasks
from ..functions.text import fold
from ..sources.tables import first_of

# The fall-back rule, and rules that heuristics don't override.
UNKNOWN = {"semantic_key": "Unknown", "mail_label": "uncategorized", "extract_tasks": True, "priority": 2}
EXCEPTIONS = ("Terms of Service Update", "Verification Code", "Security Alert")
RULE = ("semantic_key", "mail_label", "extract_tasks", "priority")
#: A second pass counts from this confidence on (exclusive, in single precision).
SECOND_PASS = 0.95


def rule_struct(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in RULE))


def unknown() -> Column:
    kinds = {"extract_tasks": "boolean", "priority": "int"}
    return F.struct(*(F.lit(v).cast(kinds.get(k, "string")).alias(k) for k, v in UNKNOWN.items()))


def _parsed(lines: DataFrame, f, name: str) -> DataFrame:
    """custom_id, name, total_tokens of the good replies for which f(content) isn't null. Each body is
    parsed once: as a generator, the result isn't computed anew by filters above it."""
    good = lines.where(~F.col("has_error") & (F.col("status_code") == 200))
    found = once(parse_body(F.col("body")), lambda b: F.struct(f(b["content"]).alias(name), b["total_tokens"].alias("total_tokens")))
    kept = F.filter(F.array(found), lambda r: r[name].isNotNull() & r["total_tokens"].isNotNull())
    return good.select("custom_id", F.inline(kept))


def parse_category_results(lines: DataFrame) -> DataFrame:
    """custom_id, general_category, specific_type, confidence, total_tokens of the good replies.
    ``lines``: custom_id, status_code, has_error, body (JSON of choices and usage)."""
    return _parsed(lines, parse_category_answer, "a").select("custom_id", "a.*", "total_tokens")


def parse_task_results(lines: DataFrame) -> DataFrame:
    """custom_id, tasks, total_tokens of the good task replies."""
    return _parsed(lines, parse_tasks, "tasks")


def is_label_relevant(labels: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``labels`` (mail_label) that any rule lists among its matching_labels."""
    listed = rules.select(F.explode("matching_labels").alias("mail_label")).distinct()
    return labels.join(listed, "mail_label", "left_semi")


def custom_label_filter(labels: DataFrame, prefix: str, utility: tuple[str, ...]) -> DataFrame:
    """The product's own labels without the utility ones, by name."""
    own = F.col("name").startswith(prefix) & ~F.col("name").isin(*(prefix + u for u in utility))
    return labels.where(own).orderBy("name")


def _by_key(rules: DataFrame, column: str, name: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The first rule (by id) of each folded key, as one struct column."""
    keyed = rules.withColumn("__key", fold(F.col(column)))
    return first_of(keyed, [*extra, "__key"], "id").select(*extra, "__key", rule_struct().alias(name))


def match_system_rule(replies: DataFrame, rules: DataFrame, threshold: float, heuristics: list[tuple[str, str, int]] = (), general: bool = True, protect_exceptions: bool = False) -> DataFrame:
    """Adds ``rule`` and ``heuristics_used``. ``replies``: specific_type, general_category, confidence,
    from. ``heuristics``: (text in the sender, label, priority), the first that fits wins.

    Rules are few beside the replies and are joined on folded keys; Spark broadcasts them when small.
    """
    out = replies.withColumn("__s", fold(F.col("specific_type"))).withColumn("__g", fold(F.col("general_category")) if general else F.lit(None).cast("string"))
    specific, by_label = _by_key(rules, "semantic_key", "__specific"), _by_key(rules, "mail_label", "__general")
    out = out.join(specific.withColumnRenamed("__key", "__s"), "__s", "left").join(by_label.withColumnRenamed("__key", "__g"), "__g", "left")
    chosen = F.coalesce("__specific", "__general", unknown())
    low = F.col("confidence").cast("float") < F.lit(threshold).cast("float")
    exception = chosen["semantic_key"].isin(*EXCEPTIONS)
    guess = F.lit(None).cast("struct<semantic_key:string,mail_label:string,extract_tasks:boolean,priority:int>")
    for text, label, priority in reversed(list(heuristics)):
        hit = F.struct(F.lit(text).alias("semantic_key"), F.lit(label).alias("mail_label"), F.lit(False).alias("extract_tasks"), F.lit(priority).alias("priority"))
        guess = F.when(F.col("from").contains(text), hit).otherwise(guess)
    used = F.coalesce(low & ~exception & guess.isNotNull(), F.lit(False))
    unsure = low & ~exception if protect_exceptions else low
    return out.withColumn("rule", F.when(used, guess).when(unsure, unknown()).otherwise(chosen)).withColumn("heuristics_used", used).select(*replies.columns, "rule", "heuristics_used")


def match_rule_single(replies: DataFrame, rules: DataFrame, threshold: float, heuristics: list[tuple[str, str, int]] = ()) -> DataFrame:
    """The one-list form: no general category."""
    return match_system_rule(replies, rules, threshold, heuristics, general=False)


def match_user_rule(replies: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule``: each user's first rule that equals specific_type, else Unknown."""
    own = _by_key(rules, "semantic_key", "__own", ("user_id",)).withColumnRenamed("__key", "__s")
    out = replies.withColumn("__s", fold(F.col("specific_type"))).join(own, ["user_id", "__s"], "left")
    return out.withColumn("rule", F.coalesce("__own", unknown())).select(*replies.columns, "rule")


def needs_second_pass(results: DataFrame, user_rules: DataFrame, mode: str = "unknown") -> DataFrame:
    """Adds ``second``. ``results``: user_id, mail_label (null: no result). ``unknown``: the user has
    rules and the label is uncategorized. ``labels``: uncategorized, no result, or listed by the user."""
    plain = F.col("mail_label") == UNKNOWN["mail_label"]
    if mode == "unknown":
        owners = user_rules.select("user_id").distinct().withColumn("__has", F.lit(True))
        return results.join(owners, "user_id", "left").withColumn("second", F.coalesce(F.col("__has") & plain, F.lit(False))).drop("__has")
    listed = user_rules.select("user_id", F.explode("matching_labels").alias("mail_label")).distinct().withColumn("__hit", F.lit(True))
    second = F.coalesce(plain, F.lit(True)) | F.coalesce("__hit", F.lit(False))
    return results.join(listed, ["user_id", "mail_label"], "left").withColumn("second", second).drop("__hit")


def is_sure(confidence: Column) -> Column:
    return F.coalesce(confidence.cast("float") > F.lit(SECOND_PASS).cast("float"), F.lit(False))


def merge_passes(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Per key the second pass's category, ai_answer and confidence if it is sure, else the first's;
    ``source`` is User or System."""
    fields = ("category", "ai_answer", "confidence")
    renamed = second.select(key, F.struct(*fields).alias("__second"))
    joined = first.join(renamed, key, "left")
    sure = is_sure(F.col("__second.confidence"))
    picked = {f: F.when(sure, F.col(f"__second.{f}")).otherwise(F.col(f)) for f in fields}
    return joined.select(*[c for c in first.columns if c not in fields], *(v.alias(k) for k, v in picked.items()), F.when(sure, F.lit("User")).otherwise(F.lit("System")).alias("source"))


def route_after_first(df: DataFrame) -> DataFrame:
    """Adds ``stage`` after the first pass. ``df``: replied, second, extract_tasks."""
    stage = F.when(~F.col("replied"), "failed").when(F.col("second"), "user_defined").when(F.col("extract_tasks"), "tasks").otherwise("done")
    return df.withColumn("stage", stage)


def route_after_second(df: DataFrame) -> DataFrame:
    """Adds ``stage`` after the second pass: a sure reply goes by its rule, all others to tasks."""
    sure = F.col("replied") & is_sure(F.col("confidence"))
    return df.withColumn("stage", F.when(sure & ~F.col("extract_tasks"), "done").otherwise("tasks"))


def classify_two_pass(first: DataFrame, second: DataFrame, system_rules: DataFrame, user_rules: DataFrame, threshold: float, key: str = "custom_id") -> DataFrame:
    """key, user_id, category, ai_answer, confidence, source, tokens. ``first`` and ``second`` are parsed
    replies with user_id; the answer is the raw specific_type and tokens of both passes add up."""
    one = match_system_rule(first.withColumn("from", F.lit(None).cast("string")), system_rules, threshold)
    one = one.select(key, "user_id", F.col("rule.mail_label").alias("category"), F.col("specific_type").alias("ai_answer"), "confidence", F.col("total_tokens").alias("tokens"))
    asked = needs_second_pass(one.withColumnRenamed("category", "mail_label"), user_rules).where("second").select(key)
    two = match_user_rule(second.join(asked, key, "left_semi"), user_rules)
    two = two.select(key, F.col("rule.mail_label").alias("category"), F.col("specific_type").alias("ai_answer"), "confidence", F.col("total_tokens").alias("more"))
    merged = merge_passes(one, two, key).join(two.select(key, "more"), key, "left")
    return merged.withColumn("tokens", F.col("tokens") + F.coalesce("more", F.lit(0))).drop("more")


def build_processed_email(items: DataFrame, now: Column, keep_flags: bool = False) -> DataFrame:
    """Rows of processed_email from finished items: email_id, user_id, category, ai_answer, confidence,
    tasks, label_ids, history_id, internal_date, thread_id and, with ``keep_flags``, the thread flags."""
    flag = lambda name: F.col(name) if keep_flags else F.lit(False)
    return items.select(
        F.col("email_id").alias("id"),
        "user_id",
        now.alias("processed_at"),
        F.coalesce("category", F.lit(UNKNOWN["mail_label"])).alias("category"),
        F.when(F.size("tasks") > 0, F.col("tasks")).alias("extracted_tasks"),
        next_due_date(F.col("tasks")).alias("due_date"),
        F.lit(False).alias("tasks_done"),
        F.coalesce("ai_answer", F.lit(UNKNOWN["semantic_key"])).alias("ai_answer"),
        F.coalesce(F.col("confidence").cast("string"), F.lit("0.0")).alias("ai_confidence"),
        flag("is_thread").alias("is_thread"),
        flag("has_new_reply").alias("has_new_reply"),
        "thread_id",
        is_read(F.col("label_ids")).alias("is_read"),
        "history_id",
        "internal_date",
    )


def rules_differ(a: DataFrame, b: DataFrame) -> bool:
    """True unless both hold the same set of rules."""
    a, b = a.select(*RULE), b.select(*RULE)
    return not (a.subtract(b).isEmpty() and b.subtract(a).isEmpty())


def changed_rules(a: DataFrame, b: DataFrame, by: str = "user_id") -> DataFrame:
    """by, differ for each value of ``by`` in either: whether the two hold other sets of rules for it."""
    rows = lambda d, k: d.select(by, *RULE, F.lit(k).alias("__side")).distinct()
    sides = rows(a, 1).unionByName(rows(b, 2)).groupBy(by, *RULE).agg(F.sum("__side").alias("__sides"))
    return sides.groupBy(by).agg(F.bool_or(F.col("__sides") != 3).alias("differ"))


def sync_rules(existing: DataFrame, config: DataFrame) -> tuple[DataFrame, int | None]:
    """The rules to keep, and how many were written: None if nothing changed."""
    return (config, config.count()) if rules_differ(existing, config) else (existing, None)


def rule_taxonomy(rules: DataFrame) -> DataFrame:
    """mail_label, taxonomy: the bulleted semantic keys of each label, sorted."""
    keys = F.transform(F.array_sort(F.collect_set("semantic_key")), lambda k: F.concat(F.lit('  • "'), k, F.lit('"')))
    return rules.groupBy("mail_label").agg(F.concat(F.lit('• "'), F.first("mail_label"), F.lit('"\n'), F.array_join(keys, "\n")).alias("taxonomy"))


def label_priorities(rules: DataFrame) -> DataFrame:
    """mail_label, priority: the one of the label's last rule."""
    return rules.groupBy("mail_label").agg(F.max_by("priority", "id").alias("priority"))


def users_with_rules(users: DataFrame, rules: DataFrame) -> DataFrame:
    return users.join(rules, users["id"] == rules["user_id"], "left_semi")


def rules_for(users: DataFrame, rules: DataFrame) -> DataFrame:
    return rules.join(users, rules["user_id"] == users["id"], "left_semi")


def rules_last_updated(users: DataFrame, rules: DataFrame, stamp: str = "updated_at") -> DataFrame:
    """id, last_updated: the newest change of each user's rules; without rules the earliest time."""
    newest = rules.groupBy("user_id").agg(F.max(stamp).alias("t"))
    return users.join(newest, users["id"] == newest["user_id"], "left").select("id", F.coalesce("t", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("last_updated"))


def evaluate_rule(replies: DataFrame, expected: str) -> DataFrame:
    """Adds ``outcome``: success where the reply's specific_type is the expected value."""
    return replies.withColumn("outcome", F.when(F.col("specific_type") == expected, "success").otherwise("failure"))
