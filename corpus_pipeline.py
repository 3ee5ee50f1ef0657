"""The corpus pipeline: its stages, each a function of (spark, docs, sf_dir).

Every stage takes any documents with the columns of COLUMNS, others too, and returns
those of COLUMNS (the last: its own). Null and empty texts go through as empty ones:
the classifier scores them, near-duplicate detection and surrogates leave them alone,
the mix never takes them. Null ids, languages and sources are values like others. An
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, mixing, near_duplicates, quality, surrogates
from tidewatch.llm.common import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, learnt from the labels, rejects. Repeated
    rows stay or go together; without labels all stay."""
    net = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, net).where("predicted = 1").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates, that of least id; documents
    without a word all stay."""
    return near_duplicates.without_near_duplicates(docs).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates in place of personal data; n_chars follows the new text."""
    replaced = surrogates.replace_entities(docs)
    n_chars = F.when(F.col("n_entities") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", n_chars).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as many times as the mix of its source wants, at most three."""
    copies = mixing.copies_of(docs)
    return copies.select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text, and show by decoding that nothing is lost."""
    return bpe.round_trip(docs, keep=["doc_id"])


STAGES: list = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("surrogates", private),
    ("mixing", mixed),
    ("bpe", encoded),
]
#: The classifier and the sampling of hash values cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
