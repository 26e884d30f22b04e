"""Exact deduplication against a persistent digest index.

The index is a table bucketed by digest and sorted by it inside each bucket. A new batch is reduced to
its distinct digests (map-side partial aggregation, so a group of copies costs a row a task), anti-joined
with the index by a sort-merge join that reads the index bucket by bucket, and what is new is appended.

Texts are equal when identical after lower-casing A-Z. Within a batch the row with the largest id stays;
a text that an earlier batch holds keeps that batch's id. Nulls count as the empty text, and very long texts are hashed
like others; repeated rows of one id count as rows of their group; rows without an id stay only where no row of their
text has one; an empty table gives an empty result; other columns are ignored.
DataFrame operations only: nothing runs in Python.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import private, save, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() is the fast way where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the lowercase hex SHA-256 of the folded text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(fold_ascii(text).cast("binary"), 256).alias("digest"))


class DigestIndex:
    """digest -> keep_id, bucketed and sorted by digest. buckets is fixed when the table is made."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, rows_hint: int = 0, rows_per_bucket: int = 4_000_000):
        self.spark, self.name, self.path = spark, name, path
        self.buckets = min(16384, max(8, 1 << max(0, (rows_hint // rows_per_bucket)).bit_length()))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        """One file a bucket and batch: the rows are dealt by the hash that the buckets use."""
        out = fresh.select("digest", "keep_id").repartition(self.buckets, "digest").write
        out = out.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append")
        if self.path:
            out = out.option("path", self.path)
        out.saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, prints: DataFrame) -> DataFrame:
        """Append what is new in a batch of fingerprints(). Returns digest, last_id and rows of each text of the batch."""
        groups = save(prints.groupBy("digest").agg(F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("rows")), "groups")
        fresh = groups
        if self.exists():
            fresh = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self.append(fresh.withColumnRenamed("last_id", "keep_id"))
        return groups


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size (rows of docs with the text), kept, text_sha256.

    With an index docs is one batch, and a text that the index holds keeps the index's id. Without one, a fresh index
    takes docs in two batches: the ids from a pivot on, then the smaller ones and rows without an id. So the id that
    an earlier batch left is the largest, as within one batch. The pivot is the id with the least hash. The fresh index goes
    once all is decided.
    """
    spark = docs.sparkSession
    prints = save(fingerprints(docs, id_col, text_col), "prints")
    own = index is None
    if own:
        n, pivot = prints.agg(F.count(F.lit(1)), F.min_by("doc_id", F.xxhash64("doc_id"))).first()
        index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", rows_hint=n)
        early = F.coalesce(F.col("doc_id") >= F.lit(pivot), F.lit(False))
        groups = index.add(prints.where(early)).union(index.add(prints.where(~early)))
        groups = groups.groupBy("digest").agg(F.sum("rows").alias("rows"))
    else:
        groups = index.add(prints)
    decided = save(groups.join(index.read().hint("merge"), "digest").select("digest", "keep_id", F.col("rows").alias("group_size")), "decided")
    if own:
        index.drop()
    # Both sides come from files, so both get an exchange and a hot digest can be split at run time.
    return prints.join(decided, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is in kept (doc_id, text_sha256): one row for each id and text.

    Ids decide; rows without an id are told apart by their text. Rows that repeat an id and text are reduced
    to one, which takes an aggregate only if there are such rows.
    """
    kept_id, kept_text = private("id"), private("text")
    nameless = F.when(docs[id_col].isNull(), F.sha2(fold_ascii(F.coalesce(docs[text_col], F.lit(""))).cast("binary"), 256)).otherwise("")
    right = kept.select(F.col("doc_id").alias(kept_id), F.when(F.col("doc_id").isNull(), F.col("text_sha256")).otherwise("").alias(kept_text))
    out = docs.join(right, docs[id_col].eqNullSafe(right[kept_id]) & (nameless == right[kept_text]), "left_semi")
    repeated = kept.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count()
    return out.dropDuplicates([id_col, text_col]) if repeated else out


def keep_distinct(docs: DataFrame) -> DataFrame:
    """docs without the copies: all columns, and the one row of each text that stays."""
    return keep_rows(docs, save(exact_dedup(docs).where("kept"), "kept"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
