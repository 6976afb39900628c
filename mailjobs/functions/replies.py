"""Reading the model's replies, inside Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import REPLY_BODY, TASKS


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with ``value`` computed a single time, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _kind(value: Column, path: str) -> Column:
    """The type of a JSON value: a string there says STRING, a number BIGINT, DECIMAL or DOUBLE."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _answer(v: Column) -> Column:
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    number = _kind(v, "$.confidence").rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    good = (_kind(v, "$.specific_type") == "STRING") & number
    general = F.when(_kind(v, "$.general_category") == "STRING", get("$.general_category", "string"))
    return F.when(good, F.struct(general.alias("general_category"), get("$.specific_type", "string").alias("specific_type"), get("$.confidence", "double").cast("float").alias("confidence")))


def parse_category_answer(c: Column) -> Column:
    """struct(general_category, specific_type, confidence float), or null where the text isn't JSON,
    specific_type isn't a string, or confidence isn't a number. general_category may be absent."""
    return once(F.try_parse_json(c), _answer)


def parse_body(body: Column) -> Column:
    """struct(content, total_tokens) of a reply's JSON body; null fields where it lacks them."""

    def fields(parsed: Column) -> Column:
        content = F.try_element_at(parsed["choices"], F.lit(1))["message"]["content"]
        return F.struct(content.alias("content"), parsed["usage"]["total_tokens"].alias("total_tokens"))

    return once(F.from_json(body, REPLY_BODY), fields)


def parse_tasks(c: Column) -> Column:
    """The tasks of a reply's content; null unless it is JSON with a list in which every task has a
    title. Unknown keys are ignored."""
    return once(F.from_json(c, TASKS)["tasks"], lambda tasks: F.when(F.forall(tasks, lambda t: t.isNotNull() & t["title"].isNotNull()), tasks))


def next_due_date(tasks: Column, lenient: bool = False) -> Column:
    """The earliest due date of a list of tasks, null if there is none. Only full date-times count;
    ``lenient`` also takes plain dates, as midnight."""

    def due(t: Column) -> Column:
        full = F.when(t["dueDate"].rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), t["dueDate"].try_cast("timestamp_ntz"))
        return F.coalesce(full, t["dueDate"].try_cast("date").cast("timestamp_ntz")) if lenient else full

    return F.array_min(F.transform(tasks, due))


def is_read(label_ids: Column) -> Column:
    """True unless UNREAD is among the labels; no labels count as read."""
    return ~F.array_contains(F.coalesce(label_ids, F.array().cast("array<string>")), "UNREAD")
