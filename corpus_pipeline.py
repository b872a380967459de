"""Corpus pipeline: documents without junk and near-duplicates, mixed to target weights, as token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideframe.llm import bpe, queries, simhash, weak_labels
from tideframe.session import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call junk."""
    scored, score = weak_labels.judged(docs.drop("junk_score"))
    return scored.where(score < weak_labels.JUNK_FROM).drop("junk_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for every epoch in which the mix takes them."""
    return queries.mixed(docs).drop("mix_domain", "mix_tokens", "mix_epoch")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document, and the digest of the text they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode, decode = bpe.encoder(spark, path, public_tokenizers.PATTERN), bpe.decoder(spark, path)
    ids = docs.select("doc_id", "lang", "source", encode(queries.whole()).alias("ids"))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(decode("ids"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("token_ids", token_ids)]

#: A learned classifier and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
