import importlib
import sys


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["doc_id", "new_sha256", "new_length", "n_redacted"] and df.count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_optional_part(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    e = importlib.import_module("__spark_entry__")
    assert "rewrite_documents" in e.queries() and "pipeline" not in e.queries() and not any(n.startswith("op") and n[2].isdigit() for n in e.queries())
    sys.modules.pop("__spark_entry__", None)


def test_small_tables_use_all_cores(spark, sf):
    from maskwright.session import spread

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert spread(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 40)
    assert spread(many).rdd.getNumPartitions() == 40
