"""A corpus pipeline: toxicity, near-dedup, suffix-array dedup, benchmark decontamination, byte-level BPE.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns
of documents; the last gives each document's tokens and the check of their round trip.

In every stage a null text counts as empty and stays (near-dedup and the others find nothing in it), an empty table
gives an empty one, a null doc_id is judged as any other, texts of any length are worked on whole, and columns beside
those of documents are ignored. Equal rows (id and text) are told apart nowhere: near-dedup keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, near_dedup, queries, shared, suffix_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, doesn't reject."""
    model = toxicity.fit_on(docs, shared.table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of five-word shingles: the one of least id."""
    shared.sweep(spark)  # of the stages before
    return near_dedup.one_of_each(docs, words=5, percent=80).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 200 bytes that occur more than once."""
    shared.sweep(spark)  # of the stages before
    return suffix_dedup.without_repeats(docs).select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    shared.sweep(spark)  # of the stages before
    return decontaminate.clean(docs, shared.table(spark, sf_dir, "benchmark")).select(COLUMNS)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, and the hash of what they decode to."""
    shared.sweep(spark)  # of the stages before
    got = queries.public_bpe().encode_documents(docs)
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", decontaminated),
    ("byte_bpe", tokenized),
]

#: Minimiser segments, trained models and merges are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = shared.table(spark, sf_dir, "documents")
    folder = shared.new_folder(spark, "corpus_pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
