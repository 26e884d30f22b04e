"""Helpers for passes over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of an Arrow batch on its way to Python, and of what is made of it before it is handed back.
BATCH = 2 << 20


def bounded_batches(spark=None, most: int = BATCH) -> None:
    """Arrow batches to Python in this session (default: the active one) end with the row that reaches so many bytes.

    Spark's default of 64 MiB is there several times in each of a task's workers: as the batch, as the one before and as Python's values.
    """
    from pyspark.sql import SparkSession

    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", spark or SparkSession.getActiveSession()
    if spark is None:
        return
    number, unit = re.fullmatch(r"([0-9]+) *([a-z]*)", spark.conf.get(key).strip().lower()).groups()
    if int(number) << 10 * "bkmgtp".index(unit[:1] or "b") > most:
        spark.conf.set(key, f"{most}b")


def arrow_column(one, kind: str, columns, once: bool = False):
    """A column that Python makes row by row: one(value of each column). Only these columns travel, and values go back in bounded pieces.

    once: filters on the column stay above it. Below, Spark would compute it for the filter and again for the column.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    made = to_arrow_type(T._parse_datatype_string(kind))
    bounded_batches()

    def run(batches):
        for batch in batches:
            arrays = batch if isinstance(batch, tuple) else (batch,)
            values, held = [], 0
            for row in zip(*(_values(a) for a in arrays)):
                value = one(*row)
                values.append(value)
                held += len(value) if isinstance(value, (bytes, str)) else 0
                if held >= BATCH:
                    yield pa.array(values, made)
                    values, held = [], 0
            if values:
                yield pa.array(values, made)

    run.__annotations__ = {"batches": Iterator[pa.Array] if len(columns) == 1 else Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    made_of = F.arrow_udf(run, kind)
    return (made_of.asNondeterministic() if once else made_of)(*columns)


def _values(array, rows: int = 256):
    """Python's values of an Arrow array, a few rows at a time."""
    for at in range(0, len(array), rows):
        yield from array.slice(at, rows).to_pylist()


def byte_entropy(column):
    """Bits per byte of the UTF-8 form, for whole texts: bytes are counted in one pass, whatever bytes occur. 0 for the empty string, null for null."""
    return arrow_column(_entropy, "double", [column])


def _entropy(text: str | None, piece: int = 1 << 20) -> float | None:
    import numpy as np

    if text is None:
        return None
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.zeros(256, np.int64)
    for at in range(0, len(data), piece):
        counts += np.bincount(data[at : at + piece], minlength=256)
    shares = counts[counts > 0] / max(1, len(data))
    return float(0.0 - (shares * np.log2(shares)).sum())


def slices(batches, columns, most: int = 4 << 20):
    """Arrow batches cut so that the strings and bytes of the columns have at most `most` bytes in a slice, or a slice is one row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.zeros(len(batch), np.int64)
        for name in columns:
            sizes += pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > at and total + size > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += size
        if at < len(sizes):
            yield batch.slice(at)
