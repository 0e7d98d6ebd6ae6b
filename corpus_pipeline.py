"""A training-data pipeline over documents: toxicity, exact and near duplicates, source mixing, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm._common import forget, scratch
from spanforge.llm.byte_bpe import encode_decode
from spanforge.llm.exact_dedup import drop_exact_duplicates
from spanforge.llm.mixing import apply_mix
from spanforge.llm.near_dedup import drop_near_duplicates
from spanforge.llm.queries import toxicity_model
from spanforge.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labelled documents that are not held out."""
    return drop_toxic(docs, toxicity_model(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, as in op7."""
    return drop_exact_duplicates(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component over five-word shingles at 0.8 the document with the smallest id stays."""
    return drop_near_duplicates(docs, shingle=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are there as often as the mix takes their words: not at all to three times."""
    return apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row: doc_id, source, token_ids, n_tokens, ids_sha256, decoded_sha256."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode_decode(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN, decoded_col="decoded")
    return coded.select(
        "doc_id",
        "source",
        "token_ids",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mix", mix),
    ("encode", encode),
]

#: SQL cannot fit the classifier or draw the mix; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written once; what it made for itself goes then, and its predecessor's result too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            done = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
