"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vulnsift.llm import (config_packing, decontaminate, fingerprints, hard_negatives, langid, licenses, ngram_join, packing, quality, secrets,
                          suffix_dedup, warc, whitening)
from vulnsift.llm.common import read_table, ship_package
from vulnsift.llm.oracle import ORACLE_SQL  # noqa: F401


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the 50-byte strings that a document with a smaller id holds too."""
    ship_package(spark)
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from `labels.quality` outside the held-out fold."""
    ship_package(spark)
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of shingle Jaccard similarity 0.8 and more."""
    ship_package(spark)
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents")).drop("text_key")


def op3_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of links of every document: other documents of shingle Jaccard similarity 0.8 and more."""
    ship_package(spark)
    return ngram_join.jaccard_link_counts(read_table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined fingerprint of every document and of its edited text, and their likeness."""
    ship_package(spark)
    return fingerprints.fingerprints(read_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenised and packed into windows of 1024 ids. The rank file and `packing.ADDED` hold
    the same vocabulary and ids as byte_bpe_50k.json (tests/llm compares the two)."""
    ship_package(spark)
    return packing.pack(read_table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secrets and those in decoded layers of every document."""
    ship_package(spark)
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found, with edits, in the documents: one row per document, item and place."""
    ship_package(spark)
    return decontaminate.find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from text and lang outside the held-out fold."""
    ship_package(spark)
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back by the salvage reader."""
    ship_package(spark)
    return warc.read_archives(warc.write_archives(read_table(spark, sf_dir, "pages")), with_payload=False) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenised and packed into as few sequences of 4096 ids as the configuration program allows."""
    ship_package(spark)
    return config_packing.pack_tightly(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")) \
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive among all embeddings."""
    ship_package(spark)
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every embedding on the first eight components."""
    ship_package(spark)
    return whitening.whiten(read_table(spark, sf_dir, "embeddings")) \
        .select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES = {q.__name__: q for q in (op1_suffix_dedup, op2_quality, op3_ngram_join, op3_ngram_links, op4_fingerprints, op5_licenses, op6_packing, op7_secrets,
                                     op8_decontaminate, op9_language, op10_warc, op11_best_fit, op12_hard_negatives, op13_whitening)}
