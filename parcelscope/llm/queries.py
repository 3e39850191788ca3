"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelscope.llm import (
    backoff_lm,
    bagminhash,
    bpe,
    embeddings,
    exact_dedup,
    filter_audit,
    host_quality,
    html_extract,
    langid,
    mixing,
    repair,
    secret_scan,
    vector_codes,
)
from parcelscope.llm.common import crc_class, table
from parcelscope.session import checkpoint_dir

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_LIBRARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, folder, "documents"), BYTE_RANKS, decoded=True))


def op3_bagminhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return bagminhash.classes(table(spark, folder, "documents"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_class("doc_id", 4) == 2, F.lit(False))
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(table(spark, folder, "documents")))


def op2_sorted_projections(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def op7_backoff_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = backoff_lm.score(docs, F.coalesce(crc_class("doc_id", 5) != 1, F.lit(True)))
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_repair_ids(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    repair.write(table(spark, folder, "documents"), path, BYTE_LIBRARY)
    return repair.read(spark, path)


def op9_host_quality(spark: SparkSession, folder: str) -> DataFrame:
    return host_quality.judge(table(spark, folder, "documents"))


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    found = html_extract.extract(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.marked(table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.report(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_sorted_projections": op2_sorted_projections,
    "op3_bagminhash_near_dedup": op3_bagminhash_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_secret_scan": op6_secret_scan,
    "op7_backoff_lm": op7_backoff_lm,
    "op8_repair_ids": op8_repair_ids,
    "op9_host_quality": op9_host_quality,
    "op10_html_text": op10_html_text,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op2_sorted_projections": embeddings.SQL,
    "op5_mixing": mixing.SQL,
    "op9_host_quality": host_quality.SQL,
    "op11_exact_dedup": exact_dedup.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
