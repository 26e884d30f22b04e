"""Structured Streaming: log tails, running counters, and stateful text operators.

Chunk streams have stream_id, seq, chunk and is_last; a stream's chunks arrive in order across triggers and are
sorted by seq inside one.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

CHUNK_SCHEMA = "stream_id long, seq int, chunk string, is_last boolean"


def tail(spark: SparkSession, path: str, schema: str, fmt: str = "json", newest_first: bool = False, files_per_trigger: int = 1000) -> DataFrame:
    """A growing folder as a stream: replayed from its start, or newest files first."""
    return spark.readStream.format(fmt).schema(schema).option("latestFirst", str(newest_first).lower()).option("maxFilesPerTrigger", files_per_trigger).load(path)


def counters(events: DataFrame, key: str) -> DataFrame:
    """Running counts by key; use output mode complete or update."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension: counts by tumbling window; rows later than the watermark are left out."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("start"), key, "count")


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a memory table: for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


class FrameParser:
    """Event-stream frames from chunks that may break anywhere."""

    def __init__(self, buffer: str = ""):
        self.buffer = buffer

    def push(self, chunk: str) -> list[dict]:
        # A carriage return at the end may be half of a line end.
        # Line ends of what is in the buffer were settled before, but for a last carriage return, which waits for what follows.
        settled, fresh = (self.buffer[:-1], "\r" + chunk) if self.buffer.endswith("\r") else (self.buffer, chunk)
        hold = fresh.endswith("\r")
        text = settled + (fresh[:-1] if hold else fresh).replace("\r\n", "\n")
        *whole, rest = text.split("\n\n")
        self.buffer = rest + "\r" * hold
        return [f for f in map(self.parse, whole) if f]

    def flush(self) -> list[dict]:
        rest, self.buffer = self.buffer, ""
        return [f for f in (self.parse(rest),) if f]

    @staticmethod
    def parse(frame: str) -> dict | None:
        if not frame.strip():
            return None
        out: dict = {"event": None, "id": None}
        data = []
        for line in frame.split("\n"):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "data":
                data.append(value)
            elif name in ("event", "id") and out[name] is None:
                out[name] = value
        return out | {"data": "\n".join(data)}


def _by_stream(chunks: DataFrame, schema: str, state: str, fresh: tuple, push, flush, time_col: str | None, ttl: str) -> DataFrame:
    """A stateful operator over streams of chunks. push(stream_id, state, rows sorted by seq) gives the next state (None at the stream's end) and rows
    to return; flush(stream_id, state) the rows of a stream that ends without a last chunk.

    With time_col a stream that has no chunk for ttl of event time is ended: its state is flushed and goes. Chunks that are later than ttl are left out.
    Without it, state is kept until a last chunk comes.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    if time_col:
        chunks = chunks.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, ttl)
    keep_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def run(key, batches, held):
        if held.hasTimedOut:
            rows = flush(key[0], held.get)
            held.remove()
            yield pd.DataFrame(rows, columns=names)
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        after, out = push(key[0], held.get if held.exists else fresh, rows)
        if after is None:
            held.exists and held.remove()
        else:
            held.update(after)
            if time_col:
                seen = int(rows[time_col].max().timestamp() * 1000)
                held.setTimeoutTimestamp(max(seen, held.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.EventTimeTimeout if time_col else GroupStateTimeout.NoTimeout
    return chunks.groupBy("stream_id").applyInPandasWithState(run, schema, state, "append", timeout)


def sse_frames(chunks: DataFrame, time_col: str | None = None, ttl: str = "1 hour") -> DataFrame:
    """(stream_id, event, id, data) of each frame as soon as it is complete; the rest at the stream's end, or when it has been silent for ttl."""

    def push(stream_id, state, rows):
        parser, out = FrameParser(state[0]), []
        for chunk, last in zip(rows["chunk"], rows["is_last"]):
            out += parser.push(chunk or "")
            if last:
                out += parser.flush()
        return None if rows["is_last"].any() else (parser.buffer,), [{"stream_id": stream_id} | f for f in out]

    def flush(stream_id, state):
        return [{"stream_id": stream_id} | f for f in FrameParser(state[0]).flush()]

    return _by_stream(chunks, "stream_id long, event string, id string, data string", "buffer string", ("",), push, flush, time_col, ttl)


class RollingRestore:
    """Stand-ins back to originals in a text that comes in chunks.

    What could still be the beginning of a stand-in is held back. Restored text is never searched again.
    """

    def __init__(self, pairs: dict[str, str], pending: str = ""):
        self.pairs, self.pending = {f: o for f, o in pairs.items() if f}, pending
        self.longest = max(map(len, self.pairs), default=0)
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.pairs, key=lambda f: (-len(f), f))))) if self.pairs else None

    def push(self, chunk: str) -> str:
        text = self.pending + chunk
        if not self.pattern:
            self.pending = ""
            return text
        edge = max(0, len(text) - self.longest + 1)  # a stand-in that begins before it is complete in text
        out, at = [], 0
        for m in self.pattern.finditer(text):
            if m.start() >= edge:
                break
            out += [text[at : m.start()], self.pairs[m[0]]]
            at = m.end()
        cut = max(at, edge)
        out.append(text[at:cut])
        self.pending = text[cut:]
        return "".join(out)

    def flush(self) -> str:
        text, self.pending = self.pending, ""
        return self.pattern.sub(lambda m: self.pairs[m[0]], text) if self.pattern else text


def rolling_restore(chunks: DataFrame, pairs: dict[str, str], time_col: str | None = None, ttl: str = "1 hour") -> DataFrame:
    """(stream_id, seq, text): restored pieces whose concatenation by seq is the restored stream.

    pairs is the in-flight mapping of one session, of a known small size; it is broadcast.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(dict(pairs))

    def push(stream_id, state, rows):
        op, at, out = RollingRestore(shared.value, state[0]), state[1], []
        for seq, chunk, last in zip(rows["seq"], rows["chunk"], rows["is_last"]):
            text = op.push(chunk or "")
            if last:
                text += op.flush()
            at = int(seq)
            out.append({"stream_id": stream_id, "seq": seq, "text": text})
        return None if rows["is_last"].any() else (op.pending, at), out

    def flush(stream_id, state):
        return [{"stream_id": stream_id, "seq": state[1] + 1, "text": RollingRestore(shared.value, state[0]).flush()}]

    return _by_stream(chunks, "stream_id long, seq int, text string", "pending string, seq int", ("", -1), push, flush, time_col, ttl)


PAIRS = "array<struct<fake:string,original:string>>"


def restore_with_dictionary(chunks: DataFrame, dictionary: DataFrame, scope_col: str = "scope", time_col: str | None = None, ttl: str = "1 hour") -> DataFrame:
    """(stream_id, seq, text): streams restored by the pairs of their own request and by a stored dictionary.

    chunks also has scope, whose part of the dictionary a stream uses, and pairs (array of fake and original, null if none), what the request replaced,
    on any of its chunks. dictionary is (scope, fake, original); in each trigger it is joined to the first chunks (seq 0) of new streams, so what was stored before a stream began holds for
    it, and travels once a stream; nothing is broadcast whole. A pair of the request comes before one of the dictionary with the same stand-in, whenever it arrives;
    empty stand-ins are skipped.
    """
    one = F.struct(F.col("fake"), F.col("original"))
    known = dictionary.where("fake <> '' AND original IS NOT NULL").groupBy(F.col(scope_col).alias("_scope")).agg(F.array_sort(F.collect_set(one)).alias("_known"))
    first = F.when(F.col("seq") == 0, F.col(scope_col))
    joined = chunks.join(known, first == F.col("_scope"), "left").withColumn("pairs", F.col("pairs").cast(PAIRS))

    def mapped(found) -> dict[str, str]:
        return {p["fake"]: p["original"] for p in ([] if found is None else found) if p["fake"]}

    def push(stream_id, state, rows):
        pending, at, own, stored = state[0], state[1], json.loads(state[2]), json.loads(state[3])
        for found in rows["pairs"]:
            own |= mapped(found)
        for found in rows["_known"]:
            stored |= mapped(found)
        op, out = RollingRestore(stored | own, pending), []
        for seq, chunk, last in zip(rows["seq"], rows["chunk"], rows["is_last"]):
            text = op.push(chunk or "")
            if last:
                text += op.flush()
            at = int(seq)
            out.append({"stream_id": stream_id, "seq": seq, "text": text})
        return None if rows["is_last"].any() else (op.pending, at, json.dumps(own), json.dumps(stored)), out

    def flush(stream_id, state):
        op = RollingRestore(json.loads(state[3]) | json.loads(state[2]), state[0])
        return [{"stream_id": stream_id, "seq": state[1] + 1, "text": op.flush()}]

    return _by_stream(joined, "stream_id long, seq int, text string", "pending string, seq int, own string, stored string", ("", -1, "{}", "{}"), push, flush, time_col, ttl)
