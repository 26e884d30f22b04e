"""Streaming queries: each drains what is there now and returns the sink's rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..session import table
from ..streaming import bus, stateful
from .registry import query


def folder(spark, name: str) -> str:
    """A fresh folder that driver and executors share. Only a single-process session (tests) gets one where none is set."""
    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = root or tempfile.gettempdir()
    return f"{root.rstrip('/')}/maskwright-{name}-{uuid.uuid4().hex}"


def drained(df, spark, name: str, mode: str = "append"):
    """The stream's result as a table in the shared folder; complete mode keeps the last state."""
    out = folder(spark, name)

    def write(batch, epoch):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/rows")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def events(spark, sf):
    path = f"{sf}/events*.parquet"
    return stateful.tail(spark, path, table(spark, sf, "events").schema, "parquet")


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def stream_counters(spark, sf):
    return drained(stateful.counters(events(spark, sf), "event_type"), spark, "counters", "complete")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf):
    """Extension: tumbling windows. Complete mode keeps every window."""
    counted = stateful.windowed_counts(events(spark, sf), "ts", "event_type")
    return drained(counted, spark, "daily", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, event_type FROM events WHERE value > 50")
def stream_tail(spark, sf):
    return drained(events(spark, sf).where("value > 50").select("event_id", "event_type"), spark, "tail")


@query("""WITH n AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, count(*) OVER () AS n FROM events)
SELECT seq, event_id, event_type, CASE WHEN seq = n - 1000 THEN seq ELSE 0 END AS lost FROM n WHERE seq >= n - 1000""")
def stream_bus_lag(spark, sf):
    """All events are published at once: a reader from the start keeps a bus's thousand and is told how many it lost."""
    path = folder(spark, "bus")
    bus.publish(table(spark, sf, "events"), path, "all", ("ts", "event_id"))
    event = F.from_json("value", "event_id long, event_type string")
    return drained(bus.subscribe(spark, path, 1000, "start").select("seq", event.alias("e"), "lost").select("seq", "e.event_id", "e.event_type", "lost"), spark, "lag")


def chunks(spark, sf, text):
    """Conversations cut into chunks of 7 characters, written as a source of two folders."""
    body = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("t")))), lambda x: x["t"]), "").alias("body"))
    n = F.greatest(F.ceil(F.char_length("body") / 7).cast("int"), F.lit(1))
    cut = body.select(F.col("conv_id").alias("stream_id"), "body", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    rows = cut.select("stream_id", "seq", F.substr("body", F.col("seq") * 7 + 1, F.lit(7)).alias("chunk"), (F.col("seq") == F.col("n") - 1).alias("is_last"))
    path = folder(spark, "chunks")
    rows.where("NOT is_last").write.parquet(f"{path}/a")
    rows.where("is_last").write.parquet(f"{path}/b")
    return stateful.tail(spark, f"{path}/*", spark.read.parquet(f"{path}/a").schema, "parquet")


def _sse():
    return F.concat(F.lit("event: "), F.col("role"), F.lit("\ndata: "), F.regexp_replace("text", "[\r\n]", " "), F.lit("\n\n"))


@query("SELECT conv_id AS stream_id, role AS event, regexp_replace(text, '[\\r\\n]', ' ', 'g') AS data FROM conversations")
def stream_sse_parser(spark, sf):
    return drained(stateful.sse_frames(chunks(spark, sf, _sse())), spark, "frames").select("stream_id", "event", "data")


PAIRS = {"that": "THAT!", "the ": "<the>", "and": "&"}


@query("SELECT conv_id AS stream_id, replace(replace(replace(string_agg(text, '' ORDER BY turn), 'that', 'THAT!'), 'the ', '<the>'), 'and', '&') AS text FROM conversations GROUP BY 1")
def stream_rolling_restore(spark, sf):
    out = drained(stateful.rolling_restore(chunks(spark, sf, F.col("text")), PAIRS), spark, "restored")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return out.groupBy("stream_id").agg(whole.alias("text"))


#: What each request replaced, and the stored pairs of each scope, of which one has another original than the request's.
OWN, STORED = ("that", "THAT!"), (("the ", "<the"), ("and", "&"), ("that", "wrong"))


@query("""SELECT conv_id AS stream_id, replace(replace(replace(string_agg(text, '' ORDER BY turn), 'that', 'THAT!'), 'the ', '<the' || conv_id % 3), 'and', '&' || conv_id % 3) AS text
FROM conversations GROUP BY conv_id""")
def stream_dictionary_restore(spark, sf):
    """Streams restored by the pairs of their request, and by a stored dictionary of their scope."""
    pair = lambda fake, original: F.struct(F.lit(fake).alias("fake"), original.alias("original"))
    scopes = table(spark, sf, "conversations").select((F.col("conv_id") % 3).alias("scope")).distinct()
    stored = F.array(*[pair(f, F.concat(F.lit(o), F.col("scope").cast("string"))) for f, o in STORED])
    path = folder(spark, "dictionary")
    scopes.select("scope", F.inline(stored)).write.parquet(path)
    made = chunks(spark, sf, F.col("text")).withColumn("scope", F.col("stream_id") % 3)
    made = made.withColumn("pairs", F.when(F.col("seq") == 0, F.array(pair(OWN[0], F.lit(OWN[1])))))
    out = drained(stateful.restore_with_dictionary(made, spark.read.parquet(path)), spark, "restored")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return out.groupBy("stream_id").agg(whole.alias("text"))
