"""The corpus pipeline: from raw documents to mixed, encoded training data.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, mixing, ngram_join, pieces, quality
from quillon.llm.common import materialize, table, workspace

#: 95 % of the tokens that reach the stage, each document at most once: what the targets don't ask
#: for is left out of the sources that have more than their share.
PIPELINE_MIX = mixing.Mix(budget_percent=95, max_epochs=1, seed="pipeline-1")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_unique(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_mixed(docs, PIPELINE_MIX)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, the digest of the text that they decode to, and whether that is the text."""
    coded = pieces.encode(docs, decode=True)
    return coded.withColumns(
        {
            "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256),
            "round_trip": F.col("decoded") == F.coalesce("text", F.lit("")),
        }
    ).drop("decoded")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("source mixing", source_mixing),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL can't express the classifier; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    at = workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"{at}/{i}")
    return docs
