"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, secrets, packing.

Every stage takes the documents its predecessor kept and is written as Parquet before the next one reads it. All but
the last return the columns of `documents`; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnsift.llm import decontaminate as _decontaminate
from vulnsift.llm import langid, ngram_join, packing, secrets
from vulnsift.llm.common import keep_table, read_table, release_held, ship_package
from vulnsift.session import checkpoint_dir

#: Ids that several rows or texts share are sent to all tasks up to this number, 16 bytes each.
SENT_IDS = 100_000

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: `und` (null text, no letter) goes. `lang` becomes the predicted language."""
    ship_package(spark)
    return langid.keep_identified(docs)


def _sent(ids: DataFrame) -> DataFrame:
    """Few ids go to all tasks; with more, joins shuffle the texts by id."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that with the smallest id. Documents without an id or without
    words link with nothing and stay. Rows that repeat an id are told apart by their texts; of rows equal in both one stays."""
    ship_package(spark)
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    # ids that several texts share get a node of their own for each text; all others are their node. Texts are read for
    # ids of several rows only
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = _sent(keep_table(again, "repeated-ids"))
    shared = named.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo <> hi")
    shared = _sent(keep_table(shared.select("doc_id", F.lit(True).alias("shared")), "shared-ids"))
    node = F.when(F.col("shared"), F.xxhash64("doc_id", "text_key")).otherwise(F.col("doc_id"))
    found = ngram_join.jaccard_components(named.join(shared, "doc_id", "left").select(node.alias("node"), "text"), "node").where("doc_id is not null")
    texts = named.join(shared, "doc_id", "left_semi").select("doc_id", "text_key").distinct().withColumn("node", F.xxhash64("doc_id", "text_key"))
    found = found.withColumnRenamed("doc_id", "node").join(texts.select("node", F.col("doc_id").alias("of")), "node", "left") \
        .select(F.coalesce("of", "node").alias("doc_id"), "text_key", "n_shingles", "component_id")
    first = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("f")).select("f.*")
    first = first.unionByName(found.where("n_shingles = 0").select("doc_id", "text_key"))
    keys = ["doc_id", "text_key"]
    kept = named.where("doc_id is not null").join(first, keys, "left_semi").dropDuplicates(keys)
    return kept.unionByName(named.where("doc_id is null")).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    release_held(spark)  # the near-duplicate stage's result is written by now
    return _decontaminate.without_items(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found masked."""
    ship_package(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents cut and packed into windows of 1024 token ids."""
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("secrets", redact_secrets), ("packing", pack)]

#: No stage but the last could be told in SQL: kernels, alignments and decoded layers. tests/llm checks every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages kept. Each stage's result is written to the shared folder and
    read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return docs
