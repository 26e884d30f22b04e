"""History, live view and performance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, history
from ..session import table
from ..sources.rules import CORE
from . import sql
from .registry import query

NOW = 1_706_659_200  # 2024-01-31
INFO = ", ".join(f"({sql.quoted(r.id)}, {sql.quoted(r.category)}, {sql.quoted(r.subcategory)}, {sql.quoted(r.severity)})" for r in CORE)
HISTORY = f"""WITH h AS ({sql.hits()}), info(rule_id, category, subcategory, severity) AS (VALUES {INFO}),
history AS (SELECT doc_id * 1000 + row_number() OVER (PARTITION BY doc_id ORDER BY "start", rule_id) AS id, 1704067200 + (doc_id * 7919) % 2592000 AS ts, rule_id, category, subcategory, severity,
  CASE WHEN doc_id % 4 = 0 THEN 'response' ELSE 'request' END AS direction, 'doc-' || doc_id AS request_id, raw FROM h JOIN info USING (rule_id)),
entries AS (SELECT id AS redaction_id, raw AS original, 'fk-' || substr(sha256(raw), 1, 12) AS fake FROM history WHERE id % 5 <> 0),
secrets AS (SELECT history.* EXCLUDE (raw), coalesce(original, '(not recorded)') AS original, coalesce(fake, '(not recorded)') AS fake FROM history LEFT JOIN entries ON id = redaction_id)
"""


def tables(spark, sf):
    """The history and entries that a scan of the documents writes."""
    from pyspark.sql import Window

    from ..sources.rules import frame

    info = F.broadcast(frame(spark).select(F.col("id").alias("rule_id"), "category", "subcategory", "severity"))
    found = detect.scan_many(table(spark, sf, "documents"), CORE, gate=False).join(info, "rule_id")
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "rule_id"))
    rows = found.select(
        (F.col("doc_id") * 1000 + rn).alias("id"), (F.lit(1704067200) + (F.col("doc_id") * 7919) % 2592000).alias("ts"), "rule_id", "category", "subcategory", "severity",
        F.when(F.col("doc_id") % 4 == 0, "response").otherwise("request").alias("direction"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("request_id"), "raw",
    )
    fake = F.concat(F.lit("fk-"), F.left(F.sha2(F.col("raw").cast("binary"), 256), F.lit(12)))
    entries = rows.where("id % 5 <> 0").select(F.col("id").alias("redaction_id"), F.col("raw").alias("original"), fake.alias("fake"))
    return rows.drop("raw"), entries


def secrets(spark, sf):
    return history.with_secrets(*tables(spark, sf))


@query(HISTORY + f"SELECT count(*) AS total, count(*) FILTER (ts >= {NOW}) AS today, count(*) FILTER (ts >= {NOW} - 6 * 86400) AS last_7_days, count(*) FILTER (ts >= {NOW} - 29 * 86400) AS last_30_days FROM history")
def history_summary(spark, sf):
    return history.summary(tables(spark, sf)[0], NOW + 5000)


@query(HISTORY + "SELECT category, subcategory, count(*) AS count FROM history GROUP BY 1, 2")
def history_by_category(spark, sf):
    return history.by_category(tables(spark, sf)[0])


@query(HISTORY + "SELECT rule_id, count(*) AS count FROM history GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def history_top_rules(spark, sf):
    return history.top_rules(tables(spark, sf)[0], 3)


@query(HISTORY + "SELECT * FROM secrets")
def history_with_secrets(spark, sf):
    return secrets(spark, sf)


PAGE = "SELECT *, CASE WHEN count(*) OVER () = {n} THEN first(ts || ':' || id) OVER (ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS next_cursor FROM (SELECT * FROM secrets {where} ORDER BY ts DESC, id DESC LIMIT {n})"


@query(HISTORY + PAGE.format(n=10, where=""))
def history_page(spark, sf):
    return history.page(secrets(spark, sf), 10)


CURSOR = "1705000000:500000"


@query(HISTORY + PAGE.format(n=1000, where="WHERE ts < 1705000000 OR (ts = 1705000000 AND id < 500000)"))
def history_cursor_page(spark, sf):
    return history.page(secrets(spark, sf), 5000, CURSOR)


@query(HISTORY + "SELECT id, original, fake FROM secrets WHERE category = 'pii' AND ts >= 1704100000 AND ts <= 1706500000 AND (original ILIKE '%1_3%' OR fake ILIKE '%1_3%')")
def history_filter_like(spark, sf):
    return history.matching(secrets(spark, sf), category="pii", since=1704100000, until=1706500000, q="1_3").select("id", "original", "fake")


@query(HISTORY + "SELECT original, arg_max(fake, (ts, id)) AS fake, arg_max(rule_id, (ts, id)) AS rule_id, arg_max(category, (ts, id)) AS category, arg_max(subcategory, (ts, id)) AS subcategory, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen FROM secrets GROUP BY 1")
def history_groups_by_original(spark, sf):
    return history.sorted_groups(history.groups_by_original(secrets(spark, sf)))


@query(HISTORY + "SELECT category, subcategory, count, floor(count * 100 / max(count) OVER () + 0.5)::INT AS pct FROM (SELECT category, subcategory, count(*) AS count FROM history GROUP BY 1, 2)")
def history_bar_pct(spark, sf):
    return history.bar_percentages(history.by_category(tables(spark, sf)[0]))


@query(HISTORY + "SELECT id, rule_id FROM history WHERE category IN ('pii') AND contains(lower(concat_ws(' ', rule_id, category, subcategory, request_id)), 'doc-1')")
def live_tail_filter(spark, sf):
    return history.tail_filter(tables(spark, sf)[0], ["pii"], "DOC-1").select("id", "rule_id")


@query(HISTORY + "SELECT id, ts FROM history WHERE contains(lower(rule_id), 'a') AND contains(lower(direction), 'requ') ORDER BY ts DESC, id DESC LIMIT 20")
def live_column_filters(spark, sf):
    rows = history.column_filters(tables(spark, sf)[0], {"rule_id": "A", "direction": "Requ"})
    return history.newest(rows, 20).select("id", "ts")


@query(HISTORY + "SELECT rule_id, count(*) AS n FROM history WHERE regexp_matches(rule_id, '(?i)^(CARD|phone)$') GROUP BY 1")
def name_regex_filter(spark, sf):
    rows = tables(spark, sf)[0]
    return rows.where(history.name_filter(F.col("rule_id"), "^(CARD|phone)$")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(HISTORY + "SELECT request_id, list_sort(list(DISTINCT rule_id)) AS rules, list_sort(list(DISTINCT rule_id))[1:3] AS top3 FROM history GROUP BY 1")
def request_labels(spark, sf):
    rules = F.array_sort(F.collect_set("rule_id"))
    return tables(spark, sf)[0].groupBy("request_id").agg(rules.alias("rules")).withColumn("top3", F.slice("rules", 1, 3))


@query(HISTORY + "SELECT a.request_id, count(DISTINCT a.id) AS requests, count(DISTINCT b.c_custkey) AS responses FROM history a JOIN (SELECT c_custkey, 'doc-' || (c_custkey % 200) AS request_id FROM customer) b USING (request_id) GROUP BY 1")
def request_response_pairs(spark, sf):
    answers = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("doc-"), (F.col("c_custkey") % 200).cast("string")).alias("request_id"))
    joined = tables(spark, sf)[0].join(answers, "request_id")
    return joined.groupBy("request_id").agg(F.countDistinct("id").alias("requests"), F.countDistinct("c_custkey").alias("responses"))


PERF = """WITH e AS (SELECT event_type AS name, (value * 1000)::BIGINT AS n FROM (SELECT event_type, floor(value * 100)::BIGINT AS value FROM events)),
b AS (SELECT name, n, CASE WHEN n < 1 THEN 0 ELSE least(length(bin(n)) - 1, 39) END AS b FROM e),
c AS (SELECT name, b, count(*) AS c, sum(n) AS s, min(n) AS lo, max(n) AS hi FROM b GROUP BY 1, 2),
r AS (SELECT *, sum(c) OVER (PARTITION BY name ORDER BY b) AS seen, sum(c) OVER (PARTITION BY name) AS total FROM c),
p AS (SELECT name, sum(c)::BIGINT AS count, sum(s) / 1e6 AS total_ms, sum(s) / sum(c) / 1e6 AS avg_ms, min(lo) / 1e6 AS min_ms, max(hi) / 1e6 AS max_ms,
  pow(2.0, min(b) FILTER (seen >= ceil(total * 0.5)) + 1) / 1e6 AS p50_ms, pow(2.0, min(b) FILTER (seen >= ceil(total * 0.95)) + 1) / 1e6 AS p95_ms, pow(2.0, min(b) FILTER (seen >= ceil(total * 0.99)) + 1) / 1e6 AS p99_ms FROM r GROUP BY 1)
"""
MS = ("total_ms", "avg_ms", "min_ms", "max_ms", "p50_ms", "p95_ms", "p99_ms")


def _perf(spark, sf):
    nanos = (F.floor(F.col("value") * 100).cast("long") * 1000).alias("n")
    return history.perf_spans(table(spark, sf, "events").select("event_type", nanos), "event_type", "n")


@query(PERF + "SELECT name, count, " + ", ".join(f"round({m}, 6) AS {m}" for m in MS) + " FROM p")
def perf_histogram_percentiles(spark, sf):
    return _perf(spark, sf).select("name", "count", *[F.round(m, 6).alias(m) for m in MS])


@query(PERF + "SELECT name, round(total_ms * 100 / sum(total_ms) OVER (), 6) AS share_pct FROM p")
def perf_shares(spark, sf):
    return history.perf_shares(_perf(spark, sf)).select("name", F.round("share_pct", 6).alias("share_pct"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) GROUP BY 1")
def event_route_projection(spark, sf):
    """Only events of the wanted types go on, as a live view does."""
    events = table(spark, sf, "events")
    wanted = F.broadcast(events.select("event_type").distinct().orderBy("event_type").limit(2))
    return events.join(wanted, "event_type", "left_semi").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(HISTORY + "SELECT id, ts, rule_id FROM history ORDER BY ts DESC, id DESC LIMIT 1000")
def live_newest(spark, sf):
    """The live view keeps the newest thousand."""
    return history.newest(tables(spark, sf)[0]).select("id", "ts", "rule_id")


def _stored(spark, sf):
    """The history appended to a store in two batches, one of them again."""
    from ..sources.stores import HistoryStore
    from .streams import folder

    rows, entries = tables(spark, sf)
    full = history.with_secrets(rows, entries).withColumnRenamed("original", "raw").where("id IS NOT NULL").persist()
    store = HistoryStore(spark, folder(spark, "history"))
    for k in (0, 1, 1):
        store.append(full.where(F.col("ts") % 2 == k), ("scan", k))
    full.unpersist()
    return store


@query(HISTORY + """, f AS (SELECT * FROM secrets WHERE rule_id = 'email' AND ts BETWEEN 1704672000 AND 1705622399), p AS (SELECT * FROM f ORDER BY ts DESC, id DESC LIMIT 20)
SELECT *, CASE WHEN (SELECT count(*) FROM p) = 20 THEN (SELECT ts || ':' || id FROM p ORDER BY ts, id LIMIT 1) END AS next_cursor FROM p""")
def history_store_page(spark, sf):
    """A page of a stored history: its days only, secrets looked up for its rows only."""
    return _stored(spark, sf).page(20, rule_id="email", since=1704672000, until=1705622399)


@query(HISTORY + "SELECT original, arg_max(rule_id, (ts, id)) AS rule_id, count(*) AS count, max(ts) AS last_seen FROM secrets WHERE ts >= 1705276800 GROUP BY 1")
def history_store_groups(spark, sf):
    return _stored(spark, sf).groups(since=1705276800).select("original", "rule_id", "count", "last_seen")
