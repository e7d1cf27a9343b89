"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together. Groups that weigh at least a fixed part of
all bytes are items of their own: there are at most as many as the parts. All
other groups are bundled by the hash of their text into a fixed number of
bundles. Items and bundles, a bounded list, go by size to the least loaded
shard through a heap; bundles keep their groups together.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bundles of small groups, and parts of all bytes from which a group is an item of its own.
BUNDLES = 4096
PARTS = 4096


def lpt(sizes: list[tuple[str, int]], shards: int) -> list[tuple[str, int]]:
    """Shard per item: the largest first, each to the least loaded shard, the lowest number at a tie."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out.append((name, shard))
    return out


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """One row per row of `df`: key, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: loads are near equal. Size is the UTF-8 bytes of the text
    and 1. A null text is in one group with the empty ones. Rows with one key
    are documents of their own. Slots run from 0 without gaps in every shard, by
    item and then key; equal rows may swap theirs. `grown_shard` is null.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(
        F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.md5(body.cast("binary")).alias("digest"),
    )
    # Salted by key: a hot group's rows are counted in many pieces.
    salt = F.pmod(F.xxhash64("key"), F.lit(BUNDLES))
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("digest"), F.lit(BUNDLES)).cast("string"))
    groups = docs.groupBy("digest").agg(F.sum("size").alias("group_size"))
    least = F.ceil(F.sum("size") / PARTS).alias("least")
    large = groups.filter(F.col("group_size") >= docs.agg(least).scalar()).select(F.col("digest").alias("large"))
    docs = docs.join(large, F.col("digest") == F.col("large"), "left")
    docs = docs.withColumn("item", F.coalesce(F.concat(F.lit("g"), "large"), bundle)).drop("large", "digest")
    docs = docs.withColumn("piece", F.when(F.col("item").startswith("g"), salt).otherwise(0).cast("int"))

    pieces = docs.groupBy("item", "piece").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("bytes"))
    items = pieces.groupBy("item").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("item_docs"))

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        """All items, at most BUNDLES + PARTS, in one call: shard, and slots taken by earlier items."""
        where = dict(lpt(list(zip(rows["item"], map(int, rows["bytes"]), strict=True)), shards))
        rows = rows.sort_values("item")
        rows["shard"] = [where[x] for x in rows["item"]]
        rows["first"] = rows.groupby("shard")["item_docs"].cumsum() - rows["item_docs"]
        return rows[["item", "shard", "first"]]

    placed = items.groupBy(F.lit(0).alias("all")).applyInPandas(lambda rows: assign(rows), "item string, shard int, first long")
    earlier = F.sum("docs").over(Window.partitionBy("item").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.select("item", "piece", F.coalesce(earlier, F.lit(0)).alias("offset")).join(placed, "item")
    place = F.row_number().over(Window.partitionBy("item", "piece").orderBy("key")) - 1
    rows = docs.withColumn("place", place).join(starts, ["item", "piece"])
    return rows.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("offset") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
