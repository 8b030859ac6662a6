"""A corpus pipeline over documents: language, near duplicates, benchmark passages, personal data, tokens.

Each stage takes the documents that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.bpe import encode_documents
from beaconry.llm.decontaminate import decontaminate
from beaconry.llm.jaccard import keep_one
from beaconry.llm.language import LanguageIdentifier, fold
from beaconry.llm.pii import mask_pii
from beaconry.llm.shared import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language ID rejects: no letters, or like no language of the labelled ones."""
    learned = docs.where(F.coalesce(fold() != 2, F.lit(False)))
    return LanguageIdentifier(learned).predict(docs).where(~F.col("rejected")).select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group linked at 0.8 Jaccard similarity of five-word shingles."""
    return keep_one(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which benchmark windows cover a twentieth of the words or more."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by the names of their kinds; n_chars follows."""
    masked = mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids and n_tokens, and whether the ids decode to the text's bytes."""
    packed = docs.drop("n_tokens", "token_ids", "round_trip")
    out = encode_documents(packed, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("token_ids", "decoded"))
    same = F.col("decoded") == F.coalesce(F.col("doc.text"), F.lit("")).cast("binary")
    return out.select("doc.*", "n_tokens", "token_ids", same.alias("round_trip"))


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("tokens", encode_bytes),
]

#: SQL cannot express the language models and the bootstrapped patterns; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
