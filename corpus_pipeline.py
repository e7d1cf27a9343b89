"""From raw documents to the token ids of a training mix.

Every stage takes the documents that the one before it kept and returns them in
the same columns; the last adds the token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surco.llm import byte_bpe, mixing, odd_sketch, quality, substrings
from surco.llm.links import arrow_rows, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject; without labels all of them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    network = quality.fit(docs, labels)
    rows = docs.select(F.struct(*docs.columns).alias("whole"), "text")
    return quality.score(rows, network).filter("predicted = 1").select("whole.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words: that of the least doc_id. Rows without doc_id stay; equal rows become one."""
    found = odd_sketch.near_duplicates(docs, width=5, share=80)
    ids = found.filter(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    stay = docs.join(ids, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return stay.unionByName(docs.filter(F.col("doc_id").isNull()))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words that a repeated window covers; n_chars follows the text."""
    return counted(substrings.without_repeats(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The runs of words that the mix takes, each a row; n_chars follows the text."""
    return counted(mixing.mixed(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with `n_tokens`, `token_ids`, and whether the ids decode to the bytes of the text.

    The ids are written before they are decoded: in one stage every core would hold two Python workers with a vocabulary
    each, and a text and its ids in two Arrow batches. The batches are of few rows for the same reason.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with arrow_rows(spark, byte_bpe.IDS_AT_ONCE):
        rows = written(byte_bpe.encode(docs, path, public_tokenizers.PATTERN))
        rows = byte_bpe.decode(rows, path)
        same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
        return written(rows.withColumn("n_tokens", F.size("token_ids").cast("long")).withColumn("round_trip", same).drop("decoded"))


def counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality classifier", quality_filter),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", mix),
    ("byte BPE", encode),
]

# Learned filters, hashes and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
