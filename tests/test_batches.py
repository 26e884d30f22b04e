"""What travels to Python: bounded batches, only the columns that are needed, each column once."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskwright.functions import arrow
from maskwright.operators import detect, route
from maskwright.plans import registry
from maskwright.sources.rules import CORE

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def brute(text):
    if text is None:
        return None
    data = text.encode()
    return -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values()) if data else 0.0


@pytest.fixture
def default(spark):
    held = spark.conf.get(KEY)
    spark.conf.unset(KEY)
    yield
    spark.conf.set(KEY, held)


def sizes(spark, rows: int, each: int):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), pa.array([len(b)], pa.int64())], names=["size", "n"])

    texts = spark.range(rows, numPartitions=1).select(F.repeat(F.lit("x"), F.lit(each)).alias("t"))
    return texts.mapInArrow(run, "size long, n long").collect()


def python_nodes(frame) -> list[str]:
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "ArrowEvalPython" in line or "MapInArrow" in line]


def test_whole_text_entropy(spark):
    texts = ["", "a", "aaaa", "abab", "é漢😀\x00\n", "".join(map(chr, range(300))) * 50, "ab" * (1 << 20) + "c", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", arrow.byte_entropy(F.col("t")).alias("e")).collect()
    assert {r.i: r.e and round(r.e, 9) for r in found} == {i: brute(t) and round(brute(t), 9) for i, t in enumerate(texts)}
    assert all(str(r.e) != "-0.0" for r in found)


def test_text_entropy_counts_bytes_in_one_pass(spark, sf):
    assert len(python_nodes(registry.QUERIES["text_entropy"](spark, sf))) == 1


@pytest.mark.parametrize("query, nodes", [("body_gzip", 4), ("body_json", 2), ("body_rule_table", 2), ("body_headers", 2), ("body_restored", 6), ("scan_compressed", 2)])
def test_each_python_column_is_made_once_of_its_own_columns(spark, sf, query, nodes):
    found = python_nodes(registry.QUERIES[query](spark, sf))
    assert len(found) == nodes and not any("MapInArrow" in line for line in found)


@pytest.mark.parametrize("given", ["64m", "67108864b", "1g", "2000000k"])
def test_batches_are_bounded_by_bytes(spark, default, given):
    spark.conf.set(KEY, given)
    arrow.bounded_batches(spark)
    found = sizes(spark, 1000, 10_000)
    assert sum(r.n for r in found) == 1000 and max(r.size for r in found) < 2 * arrow.BATCH


def test_smaller_bounds_stay(spark, default):
    for given in ("64k", "1000", "1m"):
        spark.conf.set(KEY, given)
        arrow.bounded_batches(spark)
        assert spark.conf.get(KEY) == given


def test_steps_bound_their_batches(spark, default):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    steps = (lambda: detect.scan_many(docs, CORE), lambda: detect.count_keywords(docs, ["a"]), lambda: docs.select(route.compress(F.encode("text", "utf-8"), F.lit("gzip"))))
    for step in steps:
        spark.conf.unset(KEY)
        step()
        assert spark.conf.get(KEY) == f"{arrow.BATCH}b"


def test_columns_made_in_pieces(spark):
    """More comes back than went in: pieces of values, in order, none lost."""
    n = 40
    packed = spark.range(n, numPartitions=2).select("id", F.encode(F.concat(F.repeat(F.lit("ab"), F.lit(200_000)), F.col("id").cast("string")), "utf-8").alias("b"))
    back = packed.withColumn("z", route.compress(F.col("b"), F.lit("gzip"), once=True)).withColumn("back", route.decompress(F.col("z"), F.lit("gzip")))
    assert back.where(F.col("back") == F.col("b")).count() == n
    assert spark.createDataFrame([], "b binary").select(route.decompress(F.col("b"), F.lit("gzip"))).count() == 0


def test_filters_stay_above_a_column_made_once(spark):
    texts = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "i int, t string")
    for once, nodes in ((True, 1), (False, 2)):
        z = texts.withColumn("z", route.compress(F.encode("t", "utf-8"), F.lit("gzip"), once=once)).where("z IS NOT NULL").select("i", F.octet_length("z"), F.sha2("z", 256))
        assert sorted(r.i for r in z.collect()) == [1, 3]
        assert not once or len(python_nodes(z)) == nodes
