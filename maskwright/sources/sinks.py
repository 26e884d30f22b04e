"""Sinks: rule files, live events, performance dumps. History and dictionary are in stores."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history
from .rules import Rule
from .stores import DictionaryStore, HistoryStore  # noqa: F401


def rule_file(rules: list[Rule], path: str, attribution: str = "") -> None:
    """Rules as YAML, sorted by id, under an attribution header. Scalars are written as JSON, which YAML reads."""
    lines = [f"# {x}" for x in attribution.splitlines()] + ["rules:"]
    for r in sorted(rules, key=lambda r: r.id.encode()):
        mark = "- "
        for k, v in asdict(r).items():
            lines.append(f"{mark}{k}: {json.dumps(list(v) if isinstance(v, tuple) else v, ensure_ascii=False)}")
            mark = "  "
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


#: A live event: a request with its redactions, or a response.
EVENT = "type string, id string, ts long, method string, uri string, status int, redacted array<struct<rule_id:string,category:string,subcategory:string,severity:string,original:string,fake_value:string>>"


def live_events(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    """A stream of events from a folder of JSON lines, at most so many files a trigger."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", most_files).json(path)


def requests(events: DataFrame) -> DataFrame:
    """Only requests are shown, with their first three rules and all their categories; originals stay out."""
    r = F.col("redacted")
    return events.where("type = 'request'").select(
        "id", "ts", "method", "uri", F.slice(F.transform(r, lambda x: x["rule_id"]), 1, 3).alias("labels"), F.array_distinct(F.transform(r, lambda x: x["category"])).alias("categories")
    )


def perf_dump(spans: DataFrame, path: str, seconds: int = 5, top: int = 20):
    """Writes the span statistics of every trigger, the largest totals first; spans is a stream of name and nanos."""

    def write(batch, epoch):
        found = history.perf_shares(history.perf_spans(batch, "name", "nanos")).limit(top)
        found.withColumn("epoch", F.lit(epoch)).write.mode("append").json(path)

    return spans.writeStream.trigger(processingTime=f"{seconds} seconds").foreachBatch(write)
