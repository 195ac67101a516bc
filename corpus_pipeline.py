"""A corpus pipeline over the documents table: quality rules, near duplicates, repeated passages, mixing, encoding.

Each stage takes all that the one before kept and is written as Parquet and read again. All but the last return the
columns of documents; the last returns doc_id, n_tokens and ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.llm import bpe, jaccard_join, mixing, quality_rules, suffix_dedup
from loomtide.llm.common import dropped, settled


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or the learned rules reject."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component."""
    return jaccard_join.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 200 bytes or more that occur elsewhere too."""
    return suffix_dedup.remove(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every document."""
    out = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", by_rules), ("near duplicates", near_duplicates), ("passages", passages), ("mixing", mix), ("tokens", tokens)]

#: The learned rules, the suffixes and the encoding are not SQL; tests hold run()'s rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; the table before it then goes. The last table
    stays, since what is returned reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settled(docs, f"stage{k}")
            if before:
                dropped(spark, before)
            before = docs.settled_path
    return docs
