import json

import pytest
from pyspark.sql import functions as F

from maskwright.sources import rules, sinks


def test_rule_file_reads_back(tmp_path):
    made = [rules.Rule("b", r'it\'s "x"', keywords=("k", "l"), entropy=2.5), *rules.CORE]
    sinks.rule_file(made, str(tmp_path / "r.yaml"), "line one\nline two")
    assert rules.load(str(tmp_path / "r.yaml")) == sorted(made, key=lambda r: r.id)


def test_history_store(spark, tmp_path):
    store = sinks.HistoryStore(spark, str(tmp_path))
    schema = "id long, ts long, rule_id string, category string, subcategory string, severity string, direction string, request_id string, raw string, fake string"
    rows = [(i, 1_704_067_200 + i * 40_000, f"r{i % 2}", "pii", "cc", "high", "request", "q", f"v{i % 3}", "f") for i in range(6)]
    store.append(spark.createDataFrame(rows, schema))
    assert store.summary(1_704_067_200 + 5 * 40_000).first().total == 6
    assert [r["count"] for r in store.rules(1).collect()] == [3]
    first = store.page(2).collect()
    assert [r.id for r in first] == [5, 4] and first[0].next_cursor
    second = store.page(10, first[0].next_cursor, rule_id="r1").collect()
    assert [r.id for r in second] == [3, 1] and second[0].next_cursor is None
    assert [r["count"] for r in store.groups().collect()] == [2, 2, 2]
    store.reset()
    assert store.rows().count() == 0


def test_live_events_and_perf(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = [{"type": "request", "id": "1", "redacted": [{"rule_id": f"r{i}", "category": "pii"} for i in range(4)]}, {"type": "response", "id": "1", "status": 200}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, events)))
    shown = sinks.requests(sinks.live_events(spark, str(tmp_path / "in")))
    shown.writeStream.format("memory").queryName("shown").trigger(availableNow=True).start().awaitTermination()
    row = spark.table("shown").first()
    assert row.labels == ["r0", "r1", "r2"] and row.categories == ["pii"]
    (tmp_path / "spans").mkdir()
    (tmp_path / "spans" / "a.json").write_text('{"name":"scan","nanos":1000}\n{"name":"scan","nanos":3000}\n')
    spans = spark.readStream.schema("name string, nanos long").json(str(tmp_path / "spans"))
    query = sinks.perf_dump(spans, str(tmp_path / "out"), 1).start()
    query.processAllAvailable()
    query.stop()
    assert spark.read.json(str(tmp_path / "out")).where(F.col("name") == "scan").first()["count"] == 2


def test_dictionary_store(spark, tmp_path):
    from maskwright.sources.sinks import DictionaryStore

    store = DictionaryStore(spark, str(tmp_path / "dictionary"))
    assert store.size() == 0 and store.reset() == 0
    store.upsert(spark.createDataFrame([("f1", "a"), ("f2", "b")], "fake string, original string"), 10)
    store.upsert(spark.createDataFrame([("f2", "other"), ("f3", "c")], "fake string, original string"), 20)
    assert {tuple(r) for r in store.snapshot().collect()} == {("f1", "a", 10, 10), ("f2", "b", 10, 20), ("f3", "c", 20, 20)}
    assert store.size() == 3 and store.reset() == 3 and store.size() == 0


def test_required_rules(tmp_path):
    from maskwright.sources import rules

    path = tmp_path / "rules.json"
    path.write_text('{"rules": [{"id": "a", "regex": "x"}, {"id": "b", "regex": "y"}]}')
    assert [r.id for r in rules.load(str(path), ("a", "b"))] == ["a", "b"]
    with pytest.raises(ValueError, match="no rule c"):
        rules.load(str(path), ("a", "c"))
