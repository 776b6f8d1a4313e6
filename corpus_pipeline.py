"""From documents to packed training sequences, one written table per stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.llm.frames import held_out
from topicflow.llm.minhash import drop_near_duplicates
from topicflow.llm.mixing import mix_sources
from topicflow.llm.packing import pack
from topicflow.llm.suffix_dedup import drop_repeated_bytes
from topicflow.llm.toxicity import drop_toxic
from topicflow.session import materialize

TOKENIZER = "byte_bpe_50k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Five-word shingles, similarity of 0.8 or more; a pair at that limit shares none of 24 bands of
    four values with a probability of about 3e-6.
    """
    return drop_near_duplicates(docs, size=5, percent=80, rows=4, bands=24)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 100 that occurred before are cut out of the texts."""
    return drop_repeated_bytes(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packing),
]
# a learned model, near duplicates and a packing heuristic are not for SQL; see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *stages, (_, last) = STAGES
    for name, stage in stages:
        docs = materialize(stage(spark, docs, sf_dir), name=name)
    return last(spark, docs, sf_dir)
