import json

from maskwright.streaming import bus


def read(spark, tmp_path, out):
    query = bus.subscribe(spark, str(tmp_path / "bus"), 3, "start").writeStream.format("parquet")
    query.option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(bus.SCHEMA).parquet(str(tmp_path / "out")).collect()
    return sorted((r.seq, json.loads(r.value)["id"], r.lost) for r in rows if r.seq >= out)


def test_a_lagging_reader_is_told_what_it_lost(spark, tmp_path):
    path = str(tmp_path / "bus")
    events = lambda a, b: spark.createDataFrame([(k, f"e{k:02d}", None) for k in reversed(range(a, b))], "ts long, id string, lost string").repartition(3)
    assert bus.end_of(path) == 0
    assert bus.publish(events(0, 5), path, "b0") == 5
    assert bus.publish(events(0, 5), path, "b0") == 5  # again
    assert read(spark, tmp_path, 0) == [(2, "e02", 2), (3, "e03", 0), (4, "e04", 0)]
    assert bus.publish(events(5, 7), path, "b1") == 7
    assert read(spark, tmp_path, 5) == [(5, "e05", 0), (6, "e06", 0)]
    assert bus.publish(events(0, 0), path, "b2") == 7
    assert bus.publish(events(7, 9), path, "b3") == 9
    assert bus.publish(events(9, 20), path, "b4") == 20
    assert read(spark, tmp_path, 7) == [(17, "e17", 10), (18, "e18", 0), (19, "e19", 0)]
    # A slice over two batches, and the same rows for the same offsets.
    reader = bus.BusReader(path, 100, True)
    for _ in range(2):
        got = [r for p in reader.partitions({"next": 4}, {"next": 12}) for b in reader.read(p) for r in b.to_pylist()]
        assert [(r["seq"], json.loads(r["value"])["ts"], r["lost"]) for r in got] == [(k, k, 0) for k in range(4, 12)]
    assert reader.partitions({"next": 20}, {"next": 20}) == []
    assert bus.BusReader(path, 3, False).initialOffset() == {"next": 20}
