"""Upserts: results of the plain operators, untouched folders left alone, repeated changes without effect."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from mailjobs.sources import upserts as U

BUCKETS = 8
DAY = datetime.date(2024, 1, 15)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("m"), "id").alias("id"), (F.col("id") % 5).alias("user_id"), (F.col("id") % 2 == 0).alias("is_read"), F.lit(datetime.datetime(2020, 1, 1)).alias("updated_at"))
    U.create(rows, f"{tmp_path}/t", ["id", "user_id"], BUCKETS)
    return f"{tmp_path}/t"


def test_one_row_rewrites_one_folder(spark, table):
    before = files(table)
    hit = spark.createDataFrame([("m7", 2)], "id string, user_id long")
    now = F.lit(datetime.datetime(2024, 1, 1))
    for _ in range(2):
        U.update_rows(spark, table, hit, ["id", "user_id"], BUCKETS, "is_read", F.lit(True), now)
        after = files(table)
        gone = {os.path.dirname(f) for f in set(before) - set(after)}
        assert len(gone) == 1 and all(after[f] == before[f] for f in set(before) & set(after))
        rows = {r["id"]: r for r in spark.read.parquet(table).collect()}
        assert len(rows) == 200 and rows["m7"]["is_read"] and rows["m7"]["updated_at"].year == 2024
        assert {r["updated_at"].year for k, r in rows.items() if k != "m7"} == {2020}
        now = F.lit(datetime.datetime(2025, 1, 1))  # a repeated change moves no stamp
        before = {f: t for f, t in before.items() if os.path.dirname(f) not in gone} | {f: t for f, t in after.items() if os.path.dirname(f) in gone}


def test_hits_without_a_row_change_nothing(spark, table):
    before = sorted(map(tuple, spark.read.parquet(table).collect()))
    U.update_rows(spark, table, spark.createDataFrame([("none", 1), (None, None)], "id string, user_id long"), ["id", "user_id"], BUCKETS, "is_read", F.lit(True), F.lit(datetime.datetime(2024, 1, 1)))
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == before


def test_appending(spark, tmp_path):
    path = f"{tmp_path}/t"
    U.create(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"), path, ["id"], BUCKETS)
    old = files(path)
    new = spark.createDataFrame([("a", 9), ("c", 4), ("c", 3), ("d", 5)], "id string, n int")
    for _ in range(2):
        U.append_new(spark, path, new, "id", BUCKETS, "n")
        assert sorted(map(tuple, spark.read.parquet(path).select("id", "n").collect())) == [("a", 1), ("b", 2), ("c", 3), ("d", 5)]
    assert all(files(path)[f] == t for f, t in old.items())


def test_only_touched_folders_are_read(spark, table):
    change = U.bucketed(spark.createDataFrame([("m7", 2)], "id string, user_id long"), ["id", "user_id"], BUCKETS)
    plan = U.touched(spark.read.parquet(table), change)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_tokens_are_added_once_for_each_batch(spark, tmp_path):
    path = f"{tmp_path}/usage"
    rows = spark.createDataFrame([("a", 10, None, DAY), ("b", 5, None, DAY), ("a", 7, None, datetime.date(2024, 1, 14))], "user_email string, tokens_consumed long, batch_id long, date date")
    U.create(rows, path, ["user_email"], BUCKETS, "date")
    old = {f: t for f, t in files(path).items() if "2024-01-14" in f}
    first = spark.createDataFrame([("a", 1), ("a", 2), ("c", 4)], "user_email string, tokens int")
    for deltas, batch_id in ((first, 0), (first, 0), (spark.createDataFrame([("c", 6)], "user_email string, tokens int"), 1), (first, 0)):
        U.add_tokens(spark, path, deltas, F.lit(DAY), batch_id, BUCKETS)
    got = {(r["user_email"], r["date"].day): r["tokens_consumed"] for r in spark.read.parquet(path).collect()}
    assert got == {("a", 15): 13, ("b", 15): 5, ("c", 15): 10, ("a", 14): 7}
    assert all(files(path)[f] == t for f, t in old.items())
