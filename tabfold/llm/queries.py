"""Registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabfold.llm.alignment import align_documents, pair_counts, score_links
from tabfold.llm.byte_bpe import encode_byte_bpe
from tabfold.llm.common import scratch_path
from tabfold.llm.decontamination import contaminated
from tabfold.llm.embeddings import embedding_groups
from tabfold.llm.quality import classify, fit_classifier
from tabfold.llm.sentencepiece_codec import encode_documents
from tabfold.llm.sharding import shard_documents
from tabfold.llm.simhash import simhash_groups
from tabfold.llm.spelling import spelling_variants
from tabfold.llm.substrings import substring_report
from tabfold.llm.suffixes import suffix_dedup
from tabfold.llm.token_files import read_documents, write_token_files
from tabfold.llm.urls import RULES, judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that an earlier place has, too."""
    out = substring_report(table(spark, sf_dir, "documents"))
    ends = lambda e: F.coalesce(F.transform("spans", lambda v: v[e]), F.array().cast("array<int>"))
    return out.select("doc_id", "n_spans", "n_removed", ends("s").alias("starts"), ends("e").alias("ends"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of every vector: same label, cosine 0.93 or more."""
    return embedding_groups(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document: 3-word shingles, 2 bits."""
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that start elsewhere, too."""
    return suffix_dedup(table(spark, sf_dir, "documents"), keep_text=False)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and trust propagation over every page."""
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item that a document holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into shards 0 to 7, from the written shards."""
    out = shard_documents(table(spark, sf_dir, "documents"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read from the id files through the index."""
    docs, path = table(spark, sf_dir, "documents"), scratch_path(spark, "token-files")
    shards = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    back = read_documents(docs, "doc_id", shards, path)
    return back.select(F.when(F.col("key") != -(1 << 63), F.col("key")).alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, decoded and compared."""
    out = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_xxhash64"), F.crc32("decoded").alias("decoded_crc32"), "round_trip", "parity")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and decision for every document."""
    docs = table(spark, sf_dir, "documents")
    classifier = fit_classifier(docs, table(spark, sf_dir, "labels"))
    return classify(docs.select("doc_id", "text"), classifier).select("doc_id", "p_low", "p_toxic", "rejected")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, a run in 97 with a made slip, and the forms they are near to."""
    return spelling_variants(table(spark, sf_dir, "documents"), min_chars=5, min_count=3, ratio=2.0, slip=97)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' ids of every document."""
    aligned = align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return score_links(aligned, pair_counts(aligned)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by ranks and decoded: digests of ids and bytes."""
    out = encode_byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", "n_tokens", F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_substring_dedup, op2_embedding_dedup, op3_simhash, op4_suffix_dedup, op5_url_filters, op6_decontamination, op7_sharding, op8_token_files, op9_sentencepiece, op10_quality, op11_spelling, op12_alignment, op13_byte_bpe)}
ORACLES: dict[str, str] = {}
