"""Stored history and dictionary: tables whose changes become visible by one commit each.

A change writes its files into a folder that nothing used before, then one small record names them. Readers see the records, so what a job left that failed
half-way is never read and blocks nothing; vacuum() deletes it. A record is a file that must not exist yet: of two writers at once one takes
the next number, and both changes hold. A change may carry a batch (name of a stream, number), and is skipped if that batch was committed before.
"""

from __future__ import annotations

import json
import uuid
from datetime import date, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import history


class Log:
    """Numbered records of a table's changes. A base record replaces what came up to the number it gives."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        """A record, or None for one that isn't there or that a failed job left unfinished; such a one has no effect."""
        try:
            stream = self._fs().open(self._path(name))
            try:
                return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        except (Py4JJavaError, ValueError):
            return None

    def _write(self, name: str, value: dict, overwrite: bool) -> bool:
        try:
            stream = self._fs().create(self._path(name), overwrite)
        except Py4JJavaError:
            if overwrite or not self._fs().exists(self._path(name)):
                raise
            return False
        stream.write(json.dumps(value).encode())
        stream.close()
        return True

    def _numbers(self) -> list[int]:
        found = self._fs().globStatus(self._path("_log/*.json"))
        return sorted(int(f.getPath().getName()[:-5]) for f in found or ())

    def records(self) -> list[tuple[int, dict]]:
        """What holds now, in order: the last base, if any, and later changes."""
        hint = (self._read("_log/_base") or {}).get("n", 0)
        out: list[tuple[int, dict]] = []
        for n in self._numbers():
            if n >= hint and (record := self._read(f"_log/{n:012d}.json")):
                if "upto" in record:
                    out = [(n, record), *((k, r) for k, r in out if k > record["upto"] and "upto" not in r)]
                else:
                    out.append((n, record))
        return out

    def batches(self, records) -> dict[str, int]:
        """The highest batch number of each stream."""
        out: dict[str, int] = {}
        for _, record in records:
            for name, number in [*record.get("batches", {}).items(), *([record["batch"]] if "batch" in record else [])]:
                out[name] = max(number, out.get(name, number))
        return out

    def commit(self, record: dict) -> int:
        while True:
            n = max(self._numbers(), default=0) + 1
            if self._write(f"_log/{n:012d}.json", record, overwrite=False):
                if "upto" in record:
                    self._write("_log/_base", {"n": min(n, record["upto"] + 1)}, overwrite=True)
                return n

    def replace(self, records, record: dict) -> None:
        """Commit a base for the records that were read."""
        self.commit(record | {"upto": max((n for n, _ in records), default=0), "batches": self.batches(records)})

    def vacuum(self, tables: tuple[str, ...], older_than_s: int = 86_400) -> int:
        """Delete folders that no record names, unless they are younger; returns how many. Readers of a replaced state have that long to end."""
        named = {name for _, record in self.records() for name in record.get("parts", ())}
        now, gone = self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis(), 0
        for table in tables:
            for f in self._fs().globStatus(self._path(f"{table}/part=*")) or ():
                if f.getPath().getName().removeprefix("part=") not in named and f.getModificationTime() <= now - older_than_s * 1000:
                    gone += bool(self._fs().delete(f.getPath(), True))
        return gone

    def read(self, table: str, schema: str, records, names=None) -> DataFrame:
        """The rows of the parts that the records name; schema ends in part and, if any, the partition columns."""
        parts = [p for _, record in records for p in record.get("parts", ())]
        there = [f"{self.root}/{table}/part={p}" for p in parts if self._fs().exists(self._path(f"{table}/part={p}"))]
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*there)


class HistoryStore:
    """history and entries, both by day, and the questions they answer."""

    HISTORY = "id long, ts long, rule_id string, category string, subcategory string, severity string, direction string, request_id string, part string, day date"
    ENTRIES = "redaction_id long, original string, fake string, part string, day date"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), Log(spark, root)

    def append(self, redactions: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """redactions: the history's columns, raw and fake. Two writers, one commit; False if the batch is there already."""
        if batch and self.log.batches(self.log.records()).get(batch[0], -1) >= batch[1]:
            return False
        rows, part = redactions.withColumn("day", F.to_date(F.timestamp_seconds("ts"))).persist(), uuid.uuid4().hex
        try:
            days = {str(r.day): r.n for r in rows.groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}
            self._write_history(rows, part)
            self._write_entries(rows, part)
        finally:
            rows.unpersist()
        self.log.commit({"parts": [part], "days": days} | ({"batch": list(batch)} if batch else {}))
        return True

    def _write(self, rows: DataFrame, name: str, part: str) -> None:
        rows.repartition("day").sortWithinPartitions("day").write.partitionBy("day").parquet(f"{self.root}/{name}/part={part}")

    def _write_history(self, rows: DataFrame, part: str) -> None:
        self._write(rows.drop("raw", "fake"), "history", part)

    def _write_entries(self, rows: DataFrame, part: str) -> None:
        self._write(rows.select(F.col("id").alias("redaction_id"), F.col("raw").alias("original"), "fake", "day"), "entries", part)

    def rows(self) -> DataFrame:
        return self.log.read("history", self.HISTORY, self.log.records()).drop("part", "day")

    def entries(self) -> DataFrame:
        return self.log.read("entries", self.ENTRIES, self.log.records()).drop("part", "day")

    def summary(self, now: int) -> DataFrame:
        return history.summary(self.rows(), now)

    def categories(self) -> DataFrame:
        return history.by_category(self.rows())

    def rules(self, limit: int = 20) -> DataFrame:
        return history.top_rules(self.rows(), limit)

    def _between(self, records, limit: int | None, cursor: str | None, wanted: dict) -> tuple[date | None, date | None]:
        """The first and last day that rows of a page can have: from the bounds and the cursor, and, where nothing else is asked for, from the number
        of rows of each day."""
        day = lambda ts: (date(1970, 1, 1) + timedelta(days=ts // history.DAY)) if ts is not None else None
        at = history.parse_cursor(cursor)
        low, high = day(wanted.get("since")), day(min((x for x in (wanted.get("until"), at[0] if at else None) if x is not None), default=None))
        if limit is not None and not {k for k, v in wanted.items() if v is not None} - {"since"}:
            counts: dict[date, int] = {}
            for _, record in records:
                for name, n in record.get("days", {}).items():
                    counts[date.fromisoformat(name)] = counts.get(date.fromisoformat(name), 0) + n
            seen = 0
            for name in sorted(counts, reverse=True):
                # The day of the cursor is left in, but some of its rows were shown before.
                seen += counts[name] if high is None or name < high else 0
                if seen >= limit:
                    low = max(low or name, name)
                    break
        return low, high

    def _pruned(self, low: date | None, high: date | None, records) -> tuple[DataFrame, DataFrame]:
        out = []
        for name, schema in (("history", self.HISTORY), ("entries", self.ENTRIES)):
            rows = self.log.read(name, schema, records)
            rows = rows.where(F.col("day") >= F.lit(low)) if low else rows
            out.append(rows.where(F.col("day") <= F.lit(high)) if high else rows)
        return out[0], out[1]

    def page(self, limit: int = 100, cursor: str | None = None, **wanted) -> DataFrame:
        """wanted: category, subcategory, rule_id, request_id, since, until, q. Only days that the page can have are read, and unless q is asked for, the page's rows
        are found before their secrets are looked up, within their days."""
        limit, records = history.clamp(limit), self.log.records()
        rows, entries = self._pruned(*self._between(records, limit, cursor, wanted), records)
        rows, entries = rows.drop("part"), entries.drop("part")
        if wanted.get("q") is not None:
            return history.page(history.matching(self._with_secrets(rows, entries), **wanted), limit, cursor).drop("day")
        shown = history.page(history.matching(rows, **wanted), limit, cursor)
        return self._with_secrets(F.broadcast(shown), entries, few=True).drop("day").orderBy(F.desc("ts"), F.desc("id"))

    @staticmethod
    def _with_secrets(rows: DataFrame, entries: DataFrame, few: bool = False) -> DataFrame:
        """history.with_secrets by day and id. few: rows are a page; then the entries that match it are found by a broadcast of the page's ids."""
        entries = entries.withColumnRenamed("day", "entry_day")
        on = lambda a: (entries["redaction_id"] == a["id"]) & (entries["entry_day"] == a["day"])
        if few:
            ids = rows.select("id", "day")
            entries = entries.join(F.broadcast(ids), on(ids), "left_semi")
        joined = rows.join(entries, on(rows), "left").drop("redaction_id", "entry_day")
        return joined.withColumn("original", F.coalesce("original", F.lit(history.NOT_RECORDED))).withColumn("fake", F.coalesce("fake", F.lit(history.NOT_RECORDED)))

    def groups(self, **wanted) -> DataFrame:
        records = self.log.records()
        rows, entries = self._pruned(*self._between(records, None, None, wanted), records)
        q, others = wanted.get("q"), {k: v for k, v in wanted.items() if k != "q"}
        found = self._with_secrets(history.matching(rows.drop("part"), **others), entries.drop("part"))
        return history.sorted_groups(history.groups_by_original(history.matching(found, q=q)))

    def reset(self) -> None:
        """Both tables empty, schemas kept."""
        records = self.log.records()
        self.log.replace(records, {"parts": []})

    def vacuum(self, older_than_s: int = 86_400) -> int:
        return self.log.vacuum(("history", "entries"), older_than_s)


class DictionaryStore:
    """The dictionary of stand-ins: a base and the batches upserted since. A batch writes its own rows only; they are merged when read, and
    compact() makes a new base of them, which upsert() does when they are as many rows as the base."""

    SCHEMA = "fake string, original string, created_at long, updated_at long"
    ROWS = f"{SCHEMA}, seq long, part string, bucket int"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 8, least_deltas: int = 8):
        self.spark, self.root, self.log, self.buckets, self.least_deltas = spark, root.rstrip("/"), Log(spark, root), buckets, least_deltas

    def _merged(self, records) -> DataFrame:
        """One row a stand-in: original and creation of its first batch, the latest update."""
        first = F.struct("seq", "created_at", "original")
        rows = self.log.read("dictionary", self.ROWS, records)
        merged = rows.groupBy("bucket", "fake").agg(F.min(first).alias("first"), F.max("updated_at").alias("updated_at"))
        return merged.select("fake", "first.original", "first.created_at", "updated_at", "first.seq", "bucket")

    def snapshot(self) -> DataFrame:
        return self._merged(self.log.records()).select("fake", "original", "created_at", "updated_at")

    def find(self, fakes: list[str]) -> DataFrame:
        """The rows of some stand-ins; only their buckets are read."""
        wanted = self.spark.createDataFrame([(f,) for f in fakes], "fake string").select(self._bucket().alias("b")).distinct()
        buckets = [r.b for r in wanted.collect()]
        return self._merged(self.log.records()).where(F.col("bucket").isin(buckets) & F.col("fake").isin(fakes)).select("fake", "original", "created_at", "updated_at")

    def _bucket(self):
        return F.pmod(F.xxhash64("fake"), F.lit(self.buckets)).cast("int")

    def size(self) -> int:
        return self.snapshot().count()

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        part, seen = uuid.uuid4().hex, Observation()
        out = rows.observe(seen, F.count(F.lit(1)).alias("n")).repartition("bucket").sortWithinPartitions("bucket", "fake")
        out.write.partitionBy("bucket").parquet(f"{self.root}/dictionary/part={part}")
        return part, seen.get["n"]

    def upsert(self, batch: DataFrame, now: int, number: tuple[str, int] | None = None) -> bool:
        """batch: fake, original. number: stream and number of the batch; False if it is there already."""
        records = self.log.records()
        if number and self.log.batches(records).get(number[0], -1) >= number[1]:
            return False
        seq = max((n for n, _ in records), default=0) + 1
        one = batch.where("fake IS NOT NULL").groupBy("fake").agg(F.min("original").alias("original"))
        at = F.lit(now).cast("long")
        part, rows = self._write(one.select("fake", "original", at.alias("created_at"), at.alias("updated_at"), F.lit(seq).cast("long").alias("seq"), self._bucket().alias("bucket")))
        self.log.commit({"parts": [part], "rows": rows} | ({"batch": list(number)} if number else {}))
        records = self.log.records()
        deltas = [r.get("rows", 0) for _, r in records if "upto" not in r]
        if len(deltas) >= self.least_deltas and sum(deltas) >= sum(r.get("rows", 0) for _, r in records if "upto" in r):
            self.compact()
        return True

    def compact(self) -> None:
        records = self.log.records()
        part, rows = self._write(self._merged(records))
        self.log.replace(records, {"parts": [part], "rows": rows})

    def reset(self) -> int:
        """Empties the dictionary; returns how many stand-ins it had."""
        records = self.log.records()
        n = self._merged(records).count()
        self.log.replace(records, {"parts": [], "rows": 0})
        return n

    def vacuum(self, older_than_s: int = 86_400) -> int:
        return self.log.vacuum(("dictionary",), older_than_s)
