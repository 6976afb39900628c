"""Request and reply files of the model's batch interface: JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RESULT_LINE

#: Token limit by kind of request.
MAX_TOKENS = {"categorization": 100, "tasks": 500}


def request_line(custom_id: Column, system: Column, user: Column, kind: str, temperature: float) -> Column:
    """One request as JSON; null fields are left out, and there is no model."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.struct(
        F.array(message("system", system), message("user", user)).alias("messages"),
        F.lit(temperature).alias("temperature"),
        F.lit(MAX_TOKENS[kind]).alias("max_tokens"),
        F.struct(F.lit("json_object").alias("type")).alias("response_format"),
    )
    return F.to_json(F.struct(custom_id.alias("custom_id"), body.alias("body")))


def write_batch_requests(items: DataFrame, path: str, kind: str, temperature: float) -> None:
    """``items``: custom_id, system, user."""
    items.select(request_line(F.col("custom_id"), F.col("system"), F.col("user"), kind, temperature).alias("value")).write.text(path)


def parse_result_lines(lines: DataFrame) -> DataFrame:
    """``lines``: value. Blank and unreadable lines, and those without a custom_id, are skipped."""
    read = lines.where(F.trim("value") != "").select(F.from_json("value", RESULT_LINE).alias("r"))
    return read.where(F.col("r.custom_id").isNotNull()).select("r.*")


def read_batch_results(spark: SparkSession, path: str) -> DataFrame:
    return parse_result_lines(spark.read.text(path))
