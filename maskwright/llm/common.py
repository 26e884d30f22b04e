"""Shared folder, scratch tables and the vectorised word kernel."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a single-process session (tests) gets a temporary folder where it is unset.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="maskwright-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read the table back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if _scopes:
        _scopes[-1].append(path)
    return out


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """What save() writes inside is deleted at the end, whether by an error or not, but for the tables given to the function it yields."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._scratch_path)
        return df

    _scopes.append([])
    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        for path in _scopes.pop():
            if path not in kept:
                delete(spark, path)
            elif _scopes:
                _scopes[-1].append(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Delete a table of save() that nothing reads from now on."""
    delete(df.sparkSession, df._scratch_path)


def release_scratch(spark: SparkSession) -> None:
    """Delete what save() wrote in this application; results that still read it must be written first."""
    delete(spark, f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}")


def private(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def twin(column):
    """A second join key that follows from the first.

    A side that was grouped by the first key alone then needs an exchange for the join as the other side
    does, and a join between two such exchanges is one whose hot partitions can be split at run time.
    """
    return F.xxhash64(column).alias("twin")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows in an Arrow batch of this session.

    Whole texts travel to Python in these batches; the default of 10,000 takes tens of MB in the JVM and again in each worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


# ---- words -------------------------------------------------------------------------------

#: The bytes that separate words: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LETTERS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_FOLDED = _LETTERS.copy()
_FOLDED[65:91] = _LETTERS[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        np.multiply.accumulate(np.full(size - 1, _BASE), out=up[1:])
        np.multiply.accumulate(np.full(size - 1, _BASE_INV), out=down[1:])
        _powers[size] = up, down
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string or binary array, and its n + 1 offsets. Nulls are empty."""
    import pyarrow as pa

    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the n + 1 offsets of texts into the words."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = ~SPACE[data]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = True, ~solid[:-1]
        after[-1], after[:-1] = True, ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; fold: A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _LETTERS)[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of hashes[i : i + width] at each i at which all of it fits (texts are not told apart here)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(salt)) * up[: len(hashes)], out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n] + np.uint64(width))


def blocks(batches, column: str, most: int = 4 << 20):
    """Arrow batches cut so that the texts of each part have at most `most` bytes, or one text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, size in enumerate(sizes):
            if i > at and total + size > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(size)
        if at < len(sizes):
            yield batch.slice(at) if isinstance(batch, pa.RecordBatch) else batch


# ---- counts of hashes --------------------------------------------------------------------


def counted(frame: DataFrame, hashes_of, total: int, leasts: tuple[int, ...], cells: int) -> list[np.ndarray]:
    """For each number in leasts a bitmap (2**cells bits, by leading bits) of hashes that occur at least so often.

    hashes_of yields uint64 arrays from Arrow batches of frame; total is about how many there are. This is a count-min
    sketch of one row whose cells, 40 bits behind the leading ones, are kept sparse: each task sends its partial counts by buckets of
    a few million cells, six bytes a cell, so a frequent hash costs a task no more than a rare one. Partial sketches of a
    bucket meet in one task, which folds them into its own piece of the bitmaps; these are all that comes to the
    driver. Two hashes in one cell can only raise a count, and a bitmap that fills up can only let more through.
    """
    import pyarrow as pa

    bits = min(20, max(6, (total // 2_000_000).bit_length()))
    inside = cells - bits

    def pack(grams):
        return np.ascontiguousarray((grams << np.uint64(bits) >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5])

    def send(batches):
        def flush(held):
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(grams >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            packed, n = pack(grams), np.minimum(n, 255).astype(np.uint8)
            rows = [(k, packed[a:b].tobytes(), n[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
            for i in range(0, len(rows), 64):
                k, grams, n = zip(*rows[i : i + 64])
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(grams, pa.binary()), pa.array(n, pa.binary())], names=["bucket", "grams", "counts"])

        held, size = [], 0
        for hashes in hashes_of(batches):
            held.append(hashes)
            size += len(hashes)
            if size > 2 << 20:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    def merge(batches):
        def settle(bucket, held):
            grams, n = np.zeros((sum(len(x) for _, x in held), 8), np.uint8), np.concatenate([x for _, x in held])
            grams[:, :5] = np.concatenate([x for x, _ in held])
            grams = grams.view(np.uint64).ravel()
            order = np.argsort(grams, kind="stable")
            grams, n = grams[order], n[order].astype(np.int64)
            head = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
            n, at = np.add.reduceat(n, head), (grams[head] >> np.uint64(40 - inside)).astype(np.int64)
            out = []
            for least in leasts:
                seen = np.zeros(1 << inside, np.uint8)
                seen[at[n >= least]] = 1
                out.append(pa.array([zlib.compress(np.packbits(seen, bitorder="little").tobytes(), 1)], pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *out], names=["bucket", *(f"least{x}" for x in leasts)])

        current, held = None, []
        for batch in batches:
            for k, grams, n in zip(*(batch.column(c) for c in ("bucket", "grams", "counts"))):
                if k.as_py() != current and held:
                    yield settle(current, held)
                    held = []
                current = k.as_py()
                held.append((np.frombuffer(grams.as_buffer(), np.uint8).reshape(-1, 5), np.frombuffer(n.as_buffer(), np.uint8)))
        if held:
            yield settle(current, held)

    sent = frame.mapInArrow(send, "bucket int, grams binary, counts binary")
    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "bucket int, " + ", ".join(f"least{x} binary" for x in leasts))
    bitmaps = np.zeros((len(leasts), 1 << bits, (1 << inside) // 8), np.uint8)
    for k, *pieces in found.collect():
        for row, piece in enumerate(pieces):
            bitmaps[row, k] = np.frombuffer(zlib.decompress(piece), np.uint8)
    return [b.reshape(-1) for b in bitmaps]


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash, by its leading bits, is set."""
    at = (hashes >> np.uint64(64 - (8 * len(bitmap) - 1).bit_length())).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
