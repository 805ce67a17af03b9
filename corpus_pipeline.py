"""The training-data pipeline over documents: quality rules, SimHash near-dedup, PII redaction, mixing to target
weights, SentencePiece tokens. Each stage works on all rows that the one before it kept; all but the last return the
columns of documents. Every stage's result is written to the shared folder and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import mixing, pieces, pii, quality, simhash
from lexmill.llm.common import written

#: Where the vocabulary file lies; a parameter of the last stage.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return simhash.keep_one_of_each(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts give way to their kind in angle brackets; n_chars follows."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets, in order of training position."""
    return mixing.mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    """Documents in training order, with their position in it, token ids, the number of these, and whether decoding
    gives the text back. The order is that of the files and rows in which the mix was written."""
    return pieces.encode(docs, pieces.load(model_path), number="position")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("sentencepiece", to_tokens),
]

#: Hashed sampling order and merges by rank have no SQL form; tests/llm/test_pipeline.py goes by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
