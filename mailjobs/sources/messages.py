"""Mail messages: JSON documents, and the MIME text inside them."""

from __future__ import annotations

import base64
import email
import email.policy
import email.utils
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MESSAGE

MIME = "from_address string, from_display string, subject string, body string, html string, error string"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """One message for each line; numbers that the service writes as text become numbers."""
    m = spark.read.schema(MESSAGE).json(path)
    return m.select(
        "id",
        F.col("threadId").alias("thread_id"),
        F.coalesce("labelIds", F.array().cast("array<string>")).alias("label_ids"),
        F.coalesce(F.col("historyId").try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")).alias("history_id"),
        F.coalesce(F.col("internalDate").try_cast("long"), F.lit(0)).alias("internal_date"),
        "snippet",
        "raw",
        F.col("payload.headers").alias("headers"),
    )


def parse_one(raw: str | None) -> tuple:
    """(from address, from with name, subject, first plain text, first HTML, error) of one message."""
    if raw is None:
        return None, None, None, None, None, "no raw message"
    try:
        data = base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4))
        message = email.message_from_bytes(data, policy=email.policy.default)
        name, address = email.utils.parseaddr(str(message["from"] or ""))
        texts = {}
        for part in message.walk():
            if part.get_content_type() in ("text/plain", "text/html") and not part.is_attachment():
                texts.setdefault(part.get_content_type(), part.get_content())
        subject = message["subject"]
        shown = f"{name} <{address}>" if name else address
        return address or None, shown or None, None if subject is None else str(subject), texts.get("text/plain", texts.get("text/html")), texts.get("text/html"), None
    except (ValueError, LookupError, AttributeError, KeyError) as error:
        return None, None, None, None, None, type(error).__name__


def parse_mime(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Adds the fields of MIME to every row; a message that can't be read has ``error`` set."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), MIME])
    names = [x.split()[0] for x in MIME.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = pd.DataFrame([parse_one(x) for x in batch[raw_col]], columns=names, index=batch.index, dtype=object)
            yield pd.concat([batch, parsed], axis=1)

    return df.mapInPandas(run, schema)
