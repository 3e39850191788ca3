"""The corpus pipeline: language ID, near-duplicates, secrets, the mix, and token ids, one stage after the other.

Every stage works on all rows its predecessor kept and returns the columns of ``documents``; the last returns token ids.
Null texts, repeated rows and null ids are treated as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelscope.llm import bagminhash, bpe, langid, mixing, secret_scan
from parcelscope.llm.common import crc_class, small_batches
from parcelscope.session import materialize

#: Below this score no language claims a document.
LEAST_SCORE = 0.25


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; ``und`` and those that no language claims go."""
    small_batches(spark)
    model = langid.fit(docs, F.coalesce(crc_class("doc_id", 4) != 2, F.lit(False)))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    found = langid.identify(row, model).where((F.col("language.lang_pred") != langid.UNKNOWN) & (F.col("language.score") >= LEAST_SCORE))
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-duplicate texts, whatever ids they have: see ``bagminhash.distinct``."""
    small_batches(spark)
    return bagminhash.distinct(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and ``n_chars`` counted anew."""
    masked = secret_scan.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix its token ids, the byte at which each begins, their number and the hash of the decoded bytes."""
    small_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.encode(docs, ranks, decoded=True)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "offsets", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each),
    ("secret scans", without_secrets),
    ("mixing sources", mixed),
    ("byte-level BPE", token_ids),
]

#: Language ID, signatures and token ids cannot be expressed in SQL; tests/llm compares the run with the brute force of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage returns is written and read again, so that no later read of it computes it anew."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{at}")
    return STAGES[-1][1](spark, docs, sf_dir)
