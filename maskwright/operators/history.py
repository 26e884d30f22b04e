"""Questions about the redaction history.

history: id, ts (epoch seconds), rule_id, category, subcategory, severity, direction, request_id.
entries: redaction_id, original, fake. All lists have a total order, so pages and ties are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
NOT_RECORDED = "(not recorded)"


def summary(history: DataFrame, now: int) -> DataFrame:
    """total and counts since midnight of today, of 6 and of 29 days ago, in one pass. now: epoch seconds."""
    midnight = F.unix_timestamp(F.date_trunc("DAY", F.timestamp_seconds(F.lit(now))))
    since = lambda days: F.count_if(F.col("ts") >= midnight - days * DAY)
    return history.agg(F.count(F.lit(1)).alias("total"), since(0).alias("today"), since(6).alias("last_7_days"), since(29).alias("last_30_days"))


def by_category(history: DataFrame) -> DataFrame:
    return history.groupBy("category", "subcategory").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "category", "subcategory")


def top_rules(history: DataFrame, limit: int = 20) -> DataFrame:
    return history.groupBy("rule_id").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "rule_id").limit(clamp(limit))


def clamp(limit: int, low: int = 1, high: int = 1000) -> int:
    return max(low, min(high, limit))


def with_secrets(history: DataFrame, entries: DataFrame) -> DataFrame:
    joined = history.join(entries, history["id"] == entries["redaction_id"], "left").drop("redaction_id")
    return joined.withColumn("original", F.coalesce("original", F.lit(NOT_RECORDED))).withColumn("fake", F.coalesce("fake", F.lit(NOT_RECORDED)))


def matching(rows: DataFrame, category=None, subcategory=None, rule_id=None, request_id=None, since=None, until=None, q=None) -> DataFrame:
    """Equality, inclusive time bounds, and q anywhere in original or stand-in (wildcards in q count as such)."""
    for name, value in (("category", category), ("subcategory", subcategory), ("rule_id", rule_id), ("request_id", request_id)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    if until is not None:
        rows = rows.where(F.col("ts") <= until)
    if q is not None:
        rows = rows.where(F.col("original").ilike(f"%{q}%") | F.col("fake").ilike(f"%{q}%"))
    return rows


def parse_cursor(cursor: str | None) -> tuple[int, int] | None:
    """'ts:id'; anything else is ignored."""
    a, colon, b = (cursor or "").partition(":")
    try:
        return (int(a), int(b)) if colon else None
    except ValueError:
        return None


def page(rows: DataFrame, limit: int = 100, cursor: str | None = None) -> DataFrame:
    """Newest first, the rows after the cursor; next_cursor is set on all rows iff the page is full."""
    limit = clamp(limit)
    if at := parse_cursor(cursor):
        rows = rows.where((F.col("ts") < at[0]) | ((F.col("ts") == at[0]) & (F.col("id") < at[1])))
    shown = rows.orderBy(F.desc("ts"), F.desc("id")).limit(limit)
    every = Window.partitionBy(F.lit(0))  # a page of at most 1000 rows
    last = F.min(F.struct("ts", "id")).over(every)
    return shown.withColumn("next_cursor", F.when(F.count(F.lit(1)).over(every) == limit, F.concat_ws(":", last["ts"].cast("string"), last["id"].cast("string"))))


def groups_by_original(rows: DataFrame) -> DataFrame:
    """Per original: count, first and last seen, and the attributes of its newest row."""
    newest = lambda c: F.max_by(c, F.struct("ts", "id")).alias(c)
    return rows.groupBy("original").agg(
        *[newest(c) for c in ("fake", "rule_id", "category", "subcategory")], F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )


def sorted_groups(groups: DataFrame, column: str = "count", descending: bool = True) -> DataFrame:
    return groups.orderBy(F.desc(column) if descending else F.asc(column), "original")


def bar_percentages(counts: DataFrame) -> DataFrame:
    """Share of the largest count, in rounded percent. counts: one row a category."""
    most = counts.agg(F.max("count").alias("_most"))
    return counts.crossJoin(F.broadcast(most)).withColumn("pct", F.floor(F.col("count") * 100 / F.col("_most") + 0.5).cast("int")).drop("_most")


def tail_filter(events: DataFrame, categories=None, needle: str | None = None) -> DataFrame:
    """Live view: of one of the categories, and needle (lower-cased) in the joined attributes."""
    if categories:
        events = events.where(F.col("category").isin(*categories))
    if needle:
        text = F.lower(F.concat_ws(" ", "rule_id", "category", "subcategory", "request_id"))
        events = events.where(F.contains(text, F.lit(needle.lower())))
    return events


def column_filters(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Per column a case-insensitive substring, all of them."""
    for name, q in wanted.items():
        rows = rows.where(F.contains(F.lower(F.col(name).cast("string")), F.lit(q.lower())))
    return rows


def name_filter(column: Column, q: str) -> Column:
    """q as a case-insensitive regular expression if it is one, else as a substring."""
    import re

    try:
        re.compile(q)
        return column.rlike(f"(?i){q}")
    except re.error:
        return F.contains(F.lower(column), F.lit(q.lower()))


def newest(rows: DataFrame, limit: int = 1000) -> DataFrame:
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


# ---- performance spans -------------------------------------------------------------------


def perf_spans(spans: DataFrame, name: str, nanos: str) -> DataFrame:
    """Count, total, mean, extremes and percentiles (ms) of each name.

    Percentiles come from 40 log2 buckets: the upper edge of the first bucket that reaches the share.
    """
    n = F.col(nanos).cast("long")
    bucket = F.when(n < 1, 0).otherwise(F.least(F.length(F.bin(n)) - 1, F.lit(39)))
    counts = spans.select(F.col(name).alias("name"), n.alias("n"), bucket.alias("b")).groupBy("name", "b").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    w = Window.partitionBy("name")
    run = counts.withColumn("seen", F.sum("c").over(w.orderBy("b"))).withColumn("all", F.sum("c").over(w))
    edge = lambda p: (F.min(F.when(F.col("seen") >= F.ceil(F.col("all") * F.lit(p)), F.col("b"))))
    ms = lambda c: c / 1e6
    return run.groupBy("name").agg(
        F.sum("c").alias("count"), ms(F.sum("s")).alias("total_ms"), ms(F.sum("s") / F.sum("c")).alias("avg_ms"), ms(F.min("lo")).alias("min_ms"), ms(F.max("hi")).alias("max_ms"),
        *[ms(F.pow(F.lit(2.0), edge(p) + 1)).alias(f"p{int(p * 100)}_ms") for p in (0.5, 0.95, 0.99)],
    )


def perf_shares(spans: DataFrame) -> DataFrame:
    """perf_spans() by total time, with each name's share of all time in percent. One row a name."""
    whole = spans.agg(F.sum("total_ms").alias("_all"))
    return spans.crossJoin(F.broadcast(whole)).withColumn("share_pct", F.col("total_ms") * 100 / F.col("_all")).drop("_all").orderBy(F.desc("total_ms"), "name")
