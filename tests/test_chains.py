"""Greedy chains, and what rests on them, against plain loops and the state of the streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from mailjobs.operators import chains as C
from mailjobs.operators import schedule as W
from mailjobs.streaming import jobs as J
from mailjobs.streaming import ttl as TT
from tests.test_streams import at

SCHEMA = "k string, at long, id long"


def loop(rows, gap):
    out, last = set(), {}
    for k, t, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        if k not in last or t - last[k] >= gap:
            last[k] = t
            out.add(i)
    return out


def chained(spark, rows, gap):
    df = C.taken(spark.createDataFrame(rows, SCHEMA), ["k"], "at", ["id"], gap)
    got = df.collect()
    assert sorted(r["id"] for r in got) == sorted(r[2] for r in rows if r[1] is not None)
    return {r["id"] for r in got if r["taken"]}


@pytest.mark.parametrize("block", [1, 3, 50, 1 << 14])
def test_chains(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(block)
    n = 60 if block == 1 else 400
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(n), i) for i in range(n)] + [("none", None, n)]
    assert chained(spark, rows, 7) == loop(rows, 7)


def test_chains_of_no_gap_and_of_one_row(spark):
    rows = [("a", 5, 1), ("a", 5, 2), ("b", 1, 3), ("c", 2**40, 4)]
    assert chained(spark, rows, 0) == {1, 2, 3, 4} and chained(spark, rows, 1) == {1, 3, 4}
    assert C.taken(spark.createDataFrame([], SCHEMA), ["k"], "at", ["id"], 5).count() == 0


def test_a_hot_key_goes_by_chains(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), at(rng.randrange(60_000)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "email_id string, ts timestamp, event_id long").withColumn("n", F.col("event_id") * 2)
    plain, hot = (sorted(map(tuple, TT.dedup_with_ttl(df, keep=("n",), hot=h).collect()), key=str) for h in (1 << 20, 50))
    assert plain == hot and 10 < len(plain) < 200
    assert TT.dedup_with_ttl(df, hot=0).count() == len(plain)


@pytest.mark.parametrize("seed", range(3))
def test_digests_equal_the_state_of_the_stream(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), at(rng.choice([rng.randrange(90_000), 500 + rng.random() * 9])), rng.choice(["x", "y", "z", None])) for _ in range(150)]
    want = set()
    for channel in range(3):
        state, done = TT.Digest(), []
        for t, m in sorted((t, m or "") for c, t, m in rows if c == channel):
            done += state.add(round((t - at(0)).total_seconds() * 1e6), m)
        done.append(state.close())
        want |= {(channel, at(0) + datetime.timedelta(microseconds=g[0]), *g[1:]) for g in done}
    got = TT.alert_digest(spark.createDataFrame(rows, "channel long, ts timestamp, message string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_new_ids_across_micro_batches(spark, tmp_path):
    """A repeat inside the time to live is rejected in a later micro-batch, one outside is let in."""
    schema = "user_id long, id string, internal_date long, ts timestamp, arrival long"
    rng = random.Random(1)
    batches = [
        [(1, "a", 90, at(0), 1), (1, "b", 90, at(10), 2), (2, "a", 90, at(20), 3), (1, "old", 5, at(30), 4), (7, "kept", 90, at(40), 5)],
        [(1, "a", 90, at(2000), 6), (1, "c", 90, at(2100), 7), (8, "kept", 90, at(2200), 8)],
        [(1, "a", 90, at(3700), 9), (1, "b", 90, at(3609), 10), (1, "c", 90, at(5699), 11), (1, "b", 90, at(3610), 12)],
        [(rng.randrange(5), rng.choice("abcdef"), 90, at(6000 + 60 * k), 100 + k) for k in range(200)],
    ]
    stored = spark.createDataFrame([(7, "kept")], "user_id long, id string")
    out = str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        fresh = J.new_ids_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), stored, F.lit(86_400_010), 1)
        fresh.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).foreachBatch(J.ingest_new_ids(lambda: stored, out)).start().awaitTermination()
    got = sorted(r["arrival"] for r in spark.read.parquet(f"{out}/batch=*").collect())
    twin = sorted(r["arrival"] for r in J.new_ids(spark.createDataFrame([r for b in batches for r in b], schema), stored, F.lit(86_400_010), 1).collect())
    assert got == twin and got[:7] == [1, 2, 7, 8, 9, 12, 100]


@pytest.mark.parametrize("seed", range(3))
def test_mixed_priorities_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 0, 1, 2, 3]), k, rng.randrange(60), 900, 0, rng.randrange(3)) for k in range(300)]
    used, stopped, want = {}, set(), set()
    for user, order, estimate, quota, start, priority in rows:
        now = used.setdefault(user, start)
        if user in stopped or now >= quota:
            stopped.add(user)
        elif priority == W.LOW and now > quota // 2:
            continue
        elif estimate > quota - now + quota // 100:
            stopped.add(user)
        else:
            used[user] = now + estimate
            want.add(order)
    df = spark.createDataFrame(rows, "user_id long, arrival long, estimate long, quota long, used long, priority int")
    out = W.admit_mixed(df, "arrival")
    assert {r["arrival"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_panes_are_counted_before_windows(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("user_id"), (F.timestamp_seconds(F.col("id") * 5)).alias("ts"))
    plan = J.rolling_counts(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in plan and plan.rindex("Expand") < plan.rindex("HashAggregate")
    want = {}
    for user, ts in rows.collect():
        hour = ts.replace(minute=0, second=0)
        for k in range(24):
            key = user, hour - datetime.timedelta(hours=k)
            want[key] = want.get(key, 0) + 1
    assert {(r[0], r[1]): r[2] for r in J.rolling_counts(rows).collect()} == want
