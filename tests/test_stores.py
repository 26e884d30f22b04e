"""Stored history and dictionary: failed writers, writers at once, repeated batches, pruned pages, bytes written."""

import os
import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators import history
from maskwright.sources.stores import DictionaryStore, HistoryStore, Log

SCHEMA = "id long, ts long, rule_id string, category string, subcategory string, severity string, direction string, request_id string, raw string, fake string"
T0, DAY = 1_704_067_200, 86_400


def rows_of(ids, step=DAY // 4):
    return [(i, T0 + i * step, f"r{i % 2}", "pii", "cc", "high", "request", f"q{i % 5}", f"v{i % 3}", f"f{i % 3}") for i in ids]


def frame(spark, ids, step=DAY // 4):
    return spark.createDataFrame(rows_of(ids, step), SCHEMA)


def test_a_writer_that_dies_between_the_tables_leaves_nothing(spark, tmp_path, monkeypatch):
    store = HistoryStore(spark, str(tmp_path))
    assert store.append(frame(spark, range(4)), ("s", 0))

    def die(self, rows, part):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(HistoryStore, "_write_entries", die)
        with pytest.raises(OSError, match="killed"):
            store.append(frame(spark, range(4, 8)), ("s", 1))
    assert store.rows().count() == store.entries().count() == 4
    assert len(os.listdir(tmp_path / "history")) > len(os.listdir(tmp_path / "entries"))  # what it wrote is there, but not named
    assert store.append(frame(spark, range(4, 8)), ("s", 1))
    assert not store.append(frame(spark, range(4, 8)), ("s", 1)) and not store.append(frame(spark, range(4)), ("s", 0))
    assert sorted(r.id for r in store.rows().collect()) == list(range(8)) and store.entries().count() == 8
    assert store.vacuum(older_than_s=3600) == 0 and store.vacuum(older_than_s=-60) == 1  # the dead writer's folder
    assert store.rows().count() == store.entries().count() == 8
    store.reset()
    assert store.rows().count() == 0 and store.entries().columns == ["redaction_id", "original", "fake"]
    assert not store.append(frame(spark, range(4, 8)), ("s", 1)) and store.append(frame(spark, [9]), ("s", 2))
    assert [r.id for r in store.rows().collect()] == [9]


def test_unfinished_records_and_two_writers(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    assert log.records() == []
    assert log.commit({"parts": ["a"]}) == 1
    (tmp_path / "_log" / f"{2:012d}.json").write_text("")  # died while it wrote its record
    assert log.commit({"parts": ["b"]}) == 3 and [n for n, _ in log.records()] == [1, 3]
    seen = log.records()
    assert Log(spark, str(tmp_path)).commit({"parts": ["c"]}) == 4  # another writer, while this one makes a base of what it saw
    log.replace(seen, {"parts": ["ab"]})
    assert [r["parts"] for _, r in log.records()] == [["ab"], ["c"]]
    assert not log._write(f"_log/{4:012d}.json", {}, overwrite=False)


def test_pages_read_only_their_days(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path))
    ids = list(range(80))  # four a day over 20 days
    random.Random(1).shuffle(ids)
    store.append(frame(spark, ids[:50]))
    store.append(frame(spark, ids[50:]))
    held, entries = store.rows(), store.entries()
    want = history.with_secrets(held, entries)

    def same(limit, cursor=None, **wanted):
        got = store.page(limit, cursor, **wanted)
        order = [F.desc("ts"), F.desc("id")]
        columns = sorted(got.columns)
        assert [tuple(r[c] for c in columns) for r in got.collect()] == [tuple(r[c] for c in columns) for r in history.page(history.matching(want, **wanted), limit, cursor).orderBy(*order).collect()]
        return got

    def days(df):
        """Days that the plan's partition filters let through."""
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        assert scans and all("PartitionFilters: [isnotnull(day" in line and ">= 2024-" in line for line in scans), plan
        return len({(r.ts // DAY) for r in df.collect()})

    assert days(same(6)) <= 3
    cursor = same(6).first().next_cursor
    assert days(same(6, cursor)) <= 3
    assert days(same(5, since=T0 + 3 * DAY, until=T0 + 4 * DAY)) <= 2
    assert days(same(5, cursor, since=T0 + 3 * DAY, rule_id="r1")) <= 5
    same(100)
    same(7, category="pii", request_id="q3")
    same(7, q="V1")
    same(7, q="%", until=T0 + 5 * DAY)
    seen, cursor = [], None
    while True:
        page = store.page(7, cursor).collect()
        seen += [r.id for r in page]
        cursor = page[0].next_cursor if page else None
        if not cursor:
            break
    assert seen == list(range(79, -1, -1))
    groups = {r.original: r["count"] for r in store.groups(q="v", since=T0 + DAY).collect()}
    assert groups == {"v0": 25, "v1": 26, "v2": 25}


def test_rows_without_entries_stay_on_the_page(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path))
    rows = [(*r[:-2], None, None) for r in rows_of(range(3))]
    store.append(spark.createDataFrame(rows, SCHEMA))
    assert [(r.original, r.fake) for r in store.page(2).collect()] == [(history.NOT_RECORDED,) * 2] * 2
    assert HistoryStore(spark, str(tmp_path / "none")).page(5).count() == 0


def bytes_in(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


PAIRS = "fake string, original string"


def test_dictionary_against_a_dict(spark, tmp_path):
    store, held, rnd = DictionaryStore(spark, str(tmp_path), buckets=3, least_deltas=3), {}, random.Random(2)
    for now in range(10, 100, 10):
        batch = [(f"f{rnd.randrange(30)}", f"o{rnd.randrange(9)}") for _ in range(8)] + [(None, "x"), ("f0", None)]
        assert store.upsert(spark.createDataFrame(batch, PAIRS), now, ("s", now))
        for fake in {f for f, _ in batch if f}:
            original = min((o for f, o in batch if f == fake and o), default=None)
            held[fake] = (*held[fake][:2], now) if fake in held else (original, now, now)
    want = {(f, *v) for f, v in held.items()}
    assert {tuple(r) for r in store.snapshot().collect()} == want
    assert any("upto" in r for _, r in store.log.records()) and len(store.log.records()) < 9  # compacted by itself
    assert not store.upsert(spark.createDataFrame([("new", "x")], PAIRS), 500, ("s", 90))
    assert {tuple(r) for r in store.find(["f0", "f1", "nothing"]).collect()} == {w for w in want if w[0] in ("f0", "f1")}
    store.compact()
    assert {tuple(r) for r in store.snapshot().collect()} == want and len(store.log.records()) == 1
    assert store.vacuum(older_than_s=-60) > 0 and {tuple(r) for r in store.snapshot().collect()} == want
    assert store.reset() == len(want) and store.size() == 0


def test_bytes_written_follow_the_batch(spark, tmp_path):
    store = DictionaryStore(spark, str(tmp_path), least_deltas=1000)
    big = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("fake"), F.sha2((-F.col("id")).cast("string"), 256).alias("original"))
    store.upsert(big, 1)
    before = bytes_in(tmp_path)
    store.upsert(spark.createDataFrame([("a", "x"), ("b", "y")], PAIRS), 2)
    assert bytes_in(tmp_path) - before < before / 100
    assert store.size() == 200_002


def test_a_failed_write_blocks_no_later_one(spark, tmp_path):
    store = DictionaryStore(spark, str(tmp_path))
    store.upsert(spark.createDataFrame([("f1", "a")], PAIRS), 1)
    bad = spark.range(10).select(F.raise_error(F.lit("broken")).cast("string").alias("fake"), F.lit("o").alias("original"))
    with pytest.raises(Exception, match="broken"):
        store.upsert(bad, 2)
    (tmp_path / "dictionary" / "part=dead").mkdir()
    store.upsert(spark.createDataFrame([("f2", "b")], PAIRS), 3)
    assert store.size() == 2
    stale = DictionaryStore(spark, str(tmp_path))
    records = stale.log.records()
    store.upsert(spark.createDataFrame([("f3", "c")], PAIRS), 4)  # between another's read and its commit
    stale.log.replace(records, {"parts": [p for _, r in records for p in r["parts"]], "rows": 2})
    assert store.size() == 3
