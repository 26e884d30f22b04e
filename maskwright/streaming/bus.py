"""A bus of live events with bounded lag: a reader that falls behind loses the oldest events and is told how many.

Events get gapless numbers in the order of their columns `by`. A batch is a table of Parquet files, made visible by one record
whose name holds the first and the end of its numbers; a failed writer leaves no record. There is one writer at a time.
A reader's offset is the next number. What lies more than `capacity` behind the end is lost to it, which follows from a
batch's two offsets alone, so that a batch that is run again gives the same rows.

A null event has a row, too; an empty batch gives a record without numbers; columns of any names become JSON.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CAPACITY = 1000
SCHEMA = "seq long, value string, lost long"


def _files(path: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system, root.rstrip("/")


def _records(path: str) -> list[tuple[int, int, str, str]]:
    """(first, end, batch, file) of the records, in order."""
    from pyarrow import fs

    system, root = _files(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/log", allow_not_found=True))
    names = (f.base_name.removesuffix(".json").split("-", 2) + [f.path] for f in found if f.base_name.endswith(".json"))
    return sorted((int(first), int(end), batch, file) for first, end, batch, file in names)


def end_of(path: str) -> int:
    return max((end for _, end, _, _ in _records(path)), default=0)


def publish(events: DataFrame, path: str, batch: str, by: tuple[str, ...] = ("ts", "id")) -> int:
    """Appends the events, once for a batch's name (letters and digits); gives the number after the last."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    done = _records(path)
    start = max((end for _, end, _, _ in done), default=0)
    if any(b == batch for _, _, b, _ in done):
        return start
    system, root = _files(path)
    part = f"events/{batch}-{uuid.uuid4().hex}"
    # Files are in the order of the range partitions.
    events.orderBy(*by).select(F.to_json(F.struct("*")).alias("value")).write.parquet(f"{path.rstrip('/')}/{part}")
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(f"{root}/{part}")) if f.base_name.endswith(".parquet"))
    counts = [(f"{part}/{n}", pq.read_metadata(f"{root}/{part}/{n}", filesystem=system).num_rows) for n in names]
    end = start + sum(n for _, n in counts)
    system.create_dir(f"{root}/log")
    name = f"{start:020d}-{end:020d}-{batch}"
    with system.open_output_stream(f"{root}/log/{name}.tmp") as out:
        out.write(json.dumps(counts).encode())
    system.move(f"{root}/log/{name}.tmp", f"{root}/log/{name}.json")
    return end


@dataclass
class Slice(InputPartition):
    """Rows a to b of a file; the first has the number seq and is told of the lost ones before it."""

    file: str
    a: int
    b: int
    seq: int
    lost: int


class BusReader(DataSourceStreamReader):
    def __init__(self, path: str, capacity: int, whole: bool):
        self.path, self.capacity, self.whole = path, capacity, whole

    def initialOffset(self) -> dict:
        return {"next": 0 if self.whole else end_of(self.path)}

    def latestOffset(self) -> dict:
        return {"next": end_of(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        system, _ = _files(self.path)
        first = max(start["next"], end["next"] - self.capacity)
        lost, out = first - start["next"], []
        for at, stop, _, record in _records(self.path):
            if stop <= first or at >= end["next"]:
                continue
            with system.open_input_stream(record) as f:
                counts = json.loads(f.read())
            for file, n in counts:
                a, b = max(first - at, 0), min(end["next"] - at, n)
                if a < b:
                    out.append(Slice(file, a, b, at + a, lost))
                    lost = 0
                at += n
        return out

    def read(self, partition: Slice):
        import pyarrow as pa
        import pyarrow.parquet as pq

        system, root = _files(self.path)
        at = 0
        with system.open_input_file(f"{root}/{partition.file}") as f:
            for batch in pq.ParquetFile(f).iter_batches(1000):
                a, b = max(partition.a - at, 0), min(partition.b - at, len(batch))
                if a < b:
                    seq = range(partition.seq + at + a - partition.a, partition.seq + at + b - partition.a)
                    lost = [partition.lost if s == partition.seq else 0 for s in seq]
                    arrays = [pa.array(seq, pa.int64()), batch.column("value").slice(a, b - a), pa.array(lost, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["seq", "value", "lost"])
                at += len(batch)


class EventBus(DataSource):
    """Options: path; capacity; from, `now` (as a client that connects) or `start`."""

    @classmethod
    def name(cls) -> str:
        return "event_bus"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> BusReader:
        return BusReader(self.options["path"], int(self.options.get("capacity", CAPACITY)), self.options.get("from", "now") == "start")


def subscribe(spark: SparkSession, path: str, capacity: int = CAPACITY, start: str = "now") -> DataFrame:
    """A stream of seq, value (the event as JSON) and lost (events lost right before this one)."""
    spark.dataSource.register(EventBus)
    return spark.readStream.format("event_bus").option("path", path).option("capacity", capacity).option("from", start).load()
