"""A corpus from raw documents to tokens: quality, near copies, leaked test items, personal data, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm import bpe, decontam, minhash, pii, quality
from pulseloom.llm.common import table
from pulseloom.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the log-likelihood threshold."""
    judged = quality.judge(docs.withColumn("_kept_columns", F.struct(*docs.columns)), table(spark, sf_dir, "labels"), columns=["_kept_columns"])
    return judged.filter("kept").select("_kept_columns.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies, of the smallest doc_id; rows that share an id count each by its own text."""
    return minhash.without_copies(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    flagged = decontam.flag_leaks(docs, table(spark, sf_dir, "benchmark"))
    return flagged.filter(F.size("leaks") == 0).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    found = pii.find_spans(docs, pii.fit(docs)).withColumn("text", F.col("redacted"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of ids and of the decoded text."""
    vocabulary = bpe.load_vocabulary()
    coded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), vocabulary, decoded=True)
    return coded.select(
        "doc_id", "source", "lang", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", good_quality),
    ("near copies", one_of_each),
    ("decontamination", without_test_items),
    ("personal data", without_personal_data),
    ("encoding", encoded),
]

# Fitted trees, hashed n-grams and token merges have no SQL form; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written before the next stage reads it, often more than once."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
