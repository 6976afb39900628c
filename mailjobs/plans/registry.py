"""Where queries and their DuckDB SQL are registered."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Tables, duckdb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The library never reads a clock; these are the queries' times.
NOW_SQL = "timestamp '1998-06-15 12:00:00'"
DAY_SQL = "date '2024-01-15'"
THRESHOLD = 0.30


def now() -> Column:
    return F.expr(NOW_SQL.replace("timestamp", "timestamp_ntz"))


def day() -> Column:
    return F.expr(DAY_SQL)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all machines see, under spark.checkpoint.dir. Only a local session may leave that
    unset and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='mailjobs-')}/streams/{uuid.uuid4().hex}"


def query(name: str, sql: str | None = None):
    """Registers a function of Tables as a query, with SQL over the views where there is one."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = duckdb(sql)
        return f

    return add
