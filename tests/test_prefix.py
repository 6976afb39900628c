"""Sums and frames in pieces against plain windows, with a hot key, ties and null keys."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mailjobs.operators import prefix as P


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 7)
    return spark.range(3000).select(key.alias("k"), (F.col("id") * 7919 % 500).alias("at"), F.col("id"), (F.col("id") * 31 % 11 - 3).alias("v"))


def key_of(df, *names):
    return sorted((tuple(r[n] for n in ("id", *names)) for r in df.collect()))


@pytest.mark.parametrize("pieces", [1, 2, 64])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum(rows, pieces, inclusive):
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert key_of(P.running_sum(rows, ["k"], ["at", "id"], F.col("v"), "s", pieces, inclusive), "s") == key_of(want, "s")


def test_numbered(rows):
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("at", "id")))
    assert key_of(P.numbered(rows, ["k"], ["at", "id"], "n"), "n") == key_of(want, "n")


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_sliding_range(rows, width):
    w = Window.partitionBy("k").orderBy("at").rangeBetween(-width, 0)
    want = rows.withColumn("s", F.sum("v").over(w)).withColumn("n", F.count("v").over(w))
    got = P.over_sliding_range(rows, "k", F.col("at"), width, {"s": F.sum("v"), "n": F.count("v")})
    assert key_of(got, "s", "n") == key_of(want, "s", "n")


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_sliding_range_of_least_greatest_and_null_times(rows, width):
    rows = rows.withColumn("at", F.when(F.col("id") % 41 != 0, F.col("at") - 250)).withColumn("v", F.when(F.col("id") % 5 != 0, F.col("v")))
    w = Window.partitionBy("k").orderBy("at").rangeBetween(-width, 0)
    want = rows.withColumn("s", F.sum("v").over(w)).withColumn("low", F.min(F.struct("v", "id")).over(w)["id"]).withColumn("high", F.max("at").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    values = {"s": F.sum("v"), "low": F.min(F.when(F.col("__one").isNotNull(), F.struct("v", "id"))), "high": F.max("at"), "n": F.count("__one")}
    got = P.over_sliding_range(rows, "k", F.col("at"), width, values, {"low": F.least, "high": F.greatest}).withColumn("low", F.col("low.id"))
    assert sorted(map(str, key_of(got, "s", "low", "high", "n"))) == sorted(map(str, key_of(want, "s", "low", "high", "n")))


def test_no_frame_slides(rows):
    """Spark goes through a sliding frame again for each of its rows."""
    out = P.over_sliding_range(rows, "k", F.col("at"), 10, {"s": F.sum("v")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("specifiedwindowframe") == plan.count("unboundedpreceding$(), currentrow$()") > 0


def test_empty(rows):
    assert P.numbered(rows.where("false"), ["k"], ["at"], "n").count() == 0


def test_one_task_never_holds_the_hot_key(rows):
    """The plan's windows partition by the piece as well as the key."""
    plan = P.running_sum(rows, ["k"], ["at", "id"], F.col("v"), "s")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in plan and "__piece" in plan


def test_the_input_is_computed_once(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    counted = rows.mapInPandas(count, rows.schema)
    assert P.running_sum(counted, ["k"], ["at", "id"], F.col("v"), "s").count() == 3000
    assert seen.value == 3000
    plan = P.running_sum(rows, ["k"], ["at", "id"], F.col("v"), "s")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Range (" not in plan  # what is kept is read, not the input


def test_pieces_share_a_hot_key(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"), (F.col("id") * 7919 % 9000).alias("at"))
    sizes = [r["count"] for r in P.in_pieces(rows, ["k"], ["at"], 12).groupBy("__piece").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * 9000 / 12
    assert P.in_pieces(rows, ["k"], ["at"], rows=900).select("__piece").distinct().count() == 10
