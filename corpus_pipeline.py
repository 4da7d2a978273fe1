"""A training-corpus pipeline: each stage is written as Parquet and read again as the next one's documents.

Edge cases, for all stages: whole texts are read, whatever their length; further columns are kept by all but the last, whatever
their names; an empty table gives an empty one with the same columns. Each stage says what it does with nulls, ties and
repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkveil.llm import minhash, mixing, pieces, quality, secrets
from inkveil.llm.common import discard, materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored like others; repeated rows share their fate, and
    labels join by doc_id, so a null one has none."""
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets with similarity 0.8 or more stays, that of the least doc_id, a null one
    last; of repeated rows one. Rows without words all stay."""
    return minhash.one_of_each(docs, k=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; of spans that overlap the first names the whole. Null texts stay null, repeated rows stay."""
    return secrets.without_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target weights. A null source is one of its own; rows
    without words stay once; repeated rows are rows of their own."""
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the pieces of each document; null text has the pieces of an empty one, and repeated rows their own."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Trained trees and hashed signatures have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out = materialize(out)
            discard(docs)
        docs = out
    return docs
