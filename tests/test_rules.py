import pytest
from pyspark.sql import functions as F

from mailjobs.functions import replies as C
from mailjobs.operators import rules as D

RULES = "id int, semantic_key string, mail_label string, extract_tasks boolean, priority int"


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame([(1, "Newsletter", "newsletter", False, 3), (2, "Security Alert", "alerts", True, 3), (3, "newsletter", "second", True, 1)], RULES)


def match(spark, rules, general_category, specific, confidence, sender=None, **more):
    row = spark.createDataFrame([(general_category, specific, confidence, sender)], "general_category string, specific_type string, confidence float, `from` string")
    return D.match_system_rule(row, rules, 0.5, more.pop("heuristics", ()), **more).first()


def test_match(spark, rules):
    assert match(spark, rules, "newsletter", "NEWSLETTER", 0.95)["rule"]["mail_label"] == "newsletter"
    assert match(spark, rules, "newsletter", "Newsletter", 0.3)["rule"]["mail_label"] == "uncategorized"
    assert match(spark, rules, "Something", "SomethingElse", 0.95)["rule"]["mail_label"] == "uncategorized"
    assert match(spark, rules, "ALERTS", "SomethingElse", 0.95)["rule"]["semantic_key"] == "Security Alert"
    assert match(spark, rules, "ALERTS", "SomethingElse", 0.95, general=False)["rule"]["semantic_key"] == "Unknown"


def test_heuristics_and_exceptions(spark, rules):
    h = [("@bank", "finances", 2), ("bank.com", "other", 1)]
    hit = match(spark, rules, None, "Newsletter", 0.3, "a@bank.com", heuristics=h)
    assert hit["heuristics_used"] and hit["rule"]["mail_label"] == "finances" and not hit["rule"]["extract_tasks"]
    assert match(spark, rules, None, "Security Alert", 0.3, "a@bank.com", heuristics=h)["rule"]["semantic_key"] == "Unknown"
    assert match(spark, rules, None, "Security Alert", 0.3, "a@bank.com", heuristics=h, protect_exceptions=True)["rule"]["semantic_key"] == "Security Alert"
    assert not match(spark, rules, None, "Newsletter", 0.9, "a@bank.com", heuristics=h)["heuristics_used"]


def test_threshold_is_single_precision(one):
    assert not one(D.is_sure(F.lit(0.95).cast("float")))
    assert one(D.is_sure(F.lit(0.951).cast("float")))
    assert not one(D.is_sure(F.lit(None).cast("float")))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('{"general_category": "newsletter", "specific_type": "Newsletter", "confidence": 0.95}', ("newsletter", "Newsletter")),
        ('{"specific_type": "x", "confidence": 1}', (None, "x")),
        ('{"specific_type": "x", "confidence": "0.9"}', None),
        ('{"specific_type": 5, "confidence": 0.9}', None),
        ('{"confidence": 0.9}', None),
        ("not json", None),
    ],
)
def test_answers(one, text, expected):
    got = one(C.parse_category_answer(F.lit(text)))
    assert (got and (got["general_category"], got["specific_type"])) == expected


@pytest.mark.parametrize(("text", "n"), [('{"tasks": []}', 0), ('{"tasks":[{"title":"a","due_date":"2024-01-01","priority":"high","x":1}]}', 1), ('{"tasks":[{"title":"a"},{"description":"b"}]}', None), ("x", None)])
def test_tasks(one, text, n):
    got = one(C.parse_tasks(F.lit(text)))
    assert (None if got is None else len(got)) == n
    if n:
        assert got[0]["title"] == "a" and got[0]["priority"] == "high" and got[0]["dueDate"] is None


def test_sync(spark, rules):
    assert D.sync_rules(rules, rules.orderBy("priority"))[1] is None
    assert D.sync_rules(rules, rules.limit(2))[1] == 2
