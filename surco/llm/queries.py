"""The operators of this subpackage applied to the given tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, curves, exact_dedup, html_extract, mixing, odd_sketch, periodic_runs, product_codes, quality, sharding, spelling, sql, substrings, suffix_tree

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query()
def op5_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents")).drop("runs")


@query()
def op6_shard(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard(table(spark, d, "documents"))


@query()
def op10_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.digests(
        table(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op1_main_text(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract(table(spark, d, "pages"))


@query()
def op2_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    network = quality.fit(docs, table(spark, d, "labels"))
    scored = quality.score(docs, network)
    return scored.select("doc_id", quality.is_held_out("doc_id").alias("held_out"), "score", "predicted")


@query(sql.SUBSTRINGS)
def op3_substrings(spark: SparkSession, d: str) -> DataFrame:
    removed = substrings.remove_repeats(table(spark, d, "documents"), keep_text=False)
    return removed.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(sql.NEAR_DOCUMENTS)
def op9_odd_sketch(spark: SparkSession, d: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, d, "documents"))


@query(sql.NEAR_VECTORS)
def op7_product_codes(spark: SparkSession, d: str) -> DataFrame:
    return product_codes.near_duplicates(table(spark, d, "embeddings"))


@query(sql.NEAREST)
def op8_curves(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return curves.nearest(rows, rows.filter(F.col("vec_id") % 50 == 0))


@query()
def op4_suffix_tree(spark: SparkSession, d: str) -> DataFrame:
    return suffix_tree.score(table(spark, d, "documents"))


@query(sql.EXACT)
def op13_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    # As a pattern, since a stream source takes a folder or a pattern but no single file.
    return exact_dedup.deduplicate(spark, f"{d.rstrip('/')}/documents.parquet*")


def repeated_tail(key: int | None, n: int) -> tuple[int, int] | None:
    """Texts whose key has a checksum divisible by ten end in repetitions, as the query's contract says; those without key stay."""
    if key is None:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


@query()
def op11_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    found = periodic_runs.runs(table(spark, d, "documents").select("doc_id", "text"), tail=repeated_tail)
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.when(F.size("runs") == 0, "").otherwise(F.concat(F.array_join(line, "\n"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query(sql.SPELLING)
def op12_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(table(spark, d, "documents").select("doc_id", "text"), slip=97)
