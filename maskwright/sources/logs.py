"""Audit and request logs: one JSON object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT = "timestamp string, request_id string, content_type string, rule_id string, original string, fake string, confidence string, span_start int, span_end int"
LOG = "type string, ts string, method string, uri string, status int, body string, redactions long, deanonymized long"


def audit_rows(redactions: DataFrame, request_id, content_type: str, timestamp) -> DataFrame:
    """Rows of AUDIT for redactions (rule_id, raw, fake, start, end); confidence is left empty."""
    return redactions.select(
        F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), request_id.alias("request_id"), F.lit(content_type).alias("content_type"), "rule_id",
        F.col("raw").alias("original"), "fake", F.lit("").alias("confidence"), F.col("start").alias("span_start"), F.col("end").alias("span_end"),
    )


def request_rows(bodies: DataFrame, kind: str, ts, method, uri, status, redactions=None, deanonymized=None, body_col: str = "body") -> DataFrame:
    """Rows of LOG for requests or responses (body binary); a body is shown as loggable_value() does, so that JSON is written as JSON, not as a string of it."""
    from ..operators.route import loggable_value

    count = lambda c: F.lit(None).cast("long") if c is None else c.cast("long")
    return bodies.select(
        F.lit(kind).alias("type"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), method.alias("method"), uri.alias("uri"), status.cast("int").alias("status"),
        loggable_value(F.col(body_col)).alias("body"), count(redactions).alias("redactions"), count(deanonymized).alias("deanonymized"),
    )


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)


def read_requests(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """multi_line: one pretty-printed object a file. body: text, of JSON too. caught: recorded redactions or restored values, 0 without."""
    rows = spark.read.schema(LOG).option("multiLine", str(multi_line).lower()).json(path)
    return rows.withColumn("caught", F.coalesce("redactions", "deanonymized", F.lit(0)))
