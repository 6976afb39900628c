"""Plans that have to hold at scale: filters and columns reach the scan, top-k is cut before the shuffle."""

import re

import pytest
from pyspark.sql import functions as F

from mailjobs.operators import emails as E
from mailjobs.operators import feed as G
from mailjobs.operators import schedule as W
from mailjobs.operators import usage as H
from mailjobs.plans.fixtures import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    """Views written out, so that plans begin at their own scans."""
    t, home = Tables(spark, sf), tmp_path_factory.mktemp("tables")
    for name in ("m_email", "m_usage", "m_item", "m_user"):
        t(name).write.parquet(f"{home}/{name}")
    return lambda name: spark.read.parquet(f"{home}/{name}")


def test_lookback_reaches_the_scan(files):
    p = plan(E.lookback_filter(files("m_email").select("id", "internal_date"), F.lit(10**12), 14))
    assert "GreaterThanOrEqual(internal_date" in p
    assert "ReadSchema: struct<id:string,internal_date:bigint>" in p


def test_usage_days_reach_the_scan(files):
    p = plan(H.usage_this_month(files("m_user"), files("m_usage"), 2024, 12))
    assert "GreaterThanOrEqual(date,2024-12-01)" in p and "LessThan(date,2025-01-01)" in p


def test_top_k_is_cut_before_the_shuffle(files):
    ranked = files("m_email").withColumn("priority_score", F.lit(1))
    p = plan(G.feed_all_users(ranked))
    assert re.search(r"WindowGroupLimit.*Final[\s\S]*Exchange hashpartitioning\(user_id[\s\S]*WindowGroupLimit.*Partial", p)
    p = plan(W.latest_ids(files("m_email"), files("m_email").where("false"), F.lit(0), 14, 5))
    assert "WindowGroupLimit" in p


def test_ids_are_compared_on_narrow_rows(files):
    p = plan(E.unprocessed_ids(files("m_email").select("user_id", "id"), files("m_email")))
    assert "LeftAnti" in p and set(re.findall(r"ReadSchema: struct<([^>]*)>", p)) <= {"id:string,user_id:bigint", "user_id:bigint,id:string"}


def test_no_python_in_built_in_operators(files):
    for df in (W.round_robin(files("m_item").select("user_id", "arrival"), "arrival"), W.prune_to_token_limit(files("m_item").withColumn("tokens", F.lit(1)), 5)):
        assert "Python" not in plan(df) and "Arrow" not in plan(df)
