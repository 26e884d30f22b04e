"""Corpus pipeline: toxicity, exact dedup, near dedup, personal data, packing.

Each stage gets what its predecessor kept, written as Parquet and read again, and returns the columns of
documents; the last returns packed pieces. Null texts count as empty, ids may be null or repeat, texts may be of any length, and an empty
table gives an empty result in every stage; other columns are kept, whatever their names, by all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import exact_dedup, jaccard, packing, pii, toxicity
from maskwright.llm.common import save, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.7 or more go; rows that repeat each get their own text's score, and rows without an id are scored like others."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded) the largest doc_id stays; of rows that repeat an id and text one, and a row without an id only if no row of its text has one."""
    return exact_dedup.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of five-word shingles the smallest doc_id stays; texts without words link with nothing and stay."""
    return jaccard.keep_one_of_each(docs, width=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows the new text; a null text stays null. No row goes."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; an empty or null text is a piece of one token, its end. Rows that repeat an id are pieces of their own."""
    import public_tokenizers

    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: A trained classifier and a tokenizer can't be put in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
