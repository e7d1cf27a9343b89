"""Exact deduplication by a stream whose state is kept on disk.

The files of a table are read as a stream. Per digest of the text the state
holds the number of rows and the place (file and row) of the row with the
largest key. It lives in RocksDB, never expires and outlasts the run if a
folder is given: a later run reads only files that are new.

A digest only proposes. Afterwards every row whose digest occurs twice is
compared, byte by byte, with the text at the place that the state names; rows
that differ form groups of their own by their whole text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .links import removed, shared_folder

# Input of one micro-batch at most; a batch is the unit of recovery.
BATCH_BYTES = 256 << 30
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else every partition of the state takes 4 MB of disk in advance.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _rows(table: DataFrame, key: str, text: str, digest_chars: int) -> DataFrame:
    """`id, body, sha, digest, file, row` of every row; a null text is the empty one."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = table.select(
        F.col(key).alias("id"), body.alias("body"), F.sha2(body, 256).alias("sha"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.withColumn("digest", F.unhex(F.substring("sha", 1, digest_chars)))


def hold(spark: SparkSession, path: str, folder: str, key: str, text: str, digest_chars: int, batch_bytes: int) -> DataFrame:
    """Bring the state in `folder` up to date and return it: `digest, size, id, file, row`, the last three of the row with the largest key."""
    schema = spark.read.parquet(path).schema
    own = spark.newSession()
    for name, value in {**STATE, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        own.conf.set(name, value)
    stream = own.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(path)
    groups = _rows(stream, key, text, digest_chars).groupBy("digest").agg(
        F.count(F.lit(1)).alias("size"), F.max(F.struct("id", "file", "row")).alias("holder"))
    run = groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", folder).trigger(availableNow=True).start()
    try:
        run.awaitTermination()
    finally:
        run.stop()
    if not run.lastProgress:
        return spark.createDataFrame([], f"digest binary, size long, id {dict(spark.read.parquet(path).dtypes)[key]}, file string, row long")
    state = own.read.format("statestore").load(folder).select("key.digest", F.col("value.count").alias("size"), F.col("value.max").alias("holder"))
    return state.select("digest", "size", "holder.*")


def _seen(rows: DataFrame, held: DataFrame, partitions: int) -> DataFrame:
    """Each row with what the state holds of its digest, and its text if the digest occurs twice.

    A digest with more than an even partition's rows is dealt into pieces of that
    size. Fewer digests than there are partitions can be so frequent, so their
    table is small enough for every task.
    """
    even = max(1, held.agg(F.sum("size")).first()[0] // partitions)
    pieces = F.ceil(F.col("size") / even).cast("int")
    frequent = held.filter(F.col("size") > even).select("digest", pieces.alias("pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64("file", "row"), "pieces"), F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(frequent), "digest", "left").withColumn("piece", piece).drop("pieces")
    answers = held.select(
        "digest", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), "size", pieces.alias("pieces"),
        *[F.col(c).alias(f"held_{c}") for c in ("id", "file", "row")])
    seen = dealt.join(answers, ["digest", "piece"])
    is_held = (F.col("file") == F.col("held_file")) & (F.col("row") == F.col("held_row"))
    return seen.withColumn("body", F.when(F.col("size") > 1, F.col("body"))).withColumn("kept", is_held).drop("held_file", "held_row")


def _checked(seen: DataFrame) -> DataFrame:
    """`id, sha, digest, file, row, keep_id, group_size, kept, same`; `same` if the bytes are those of the text that the state names."""
    texts = seen.filter(F.col("kept") & (F.col("size") > 1)).select(
        "digest", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("body").alias("held_body"))
    names = ["id", "sha", "digest", "file", "row", F.col("held_id").alias("keep_id"), F.col("size").alias("group_size"), "kept"]
    hits = seen.filter(F.col("size") > 1).join(texts, ["digest", "piece"])
    once = seen.filter(F.col("size") == 1).select(*names, F.lit(True).alias("same"))
    return once.unionByName(hits.select(*names, (F.col("body") == F.col("held_body")).alias("same")))


def _regrouped(checked: DataFrame, rows: DataFrame) -> DataFrame:
    """The groups of those digests of which some rows differ, by whole text: rows like the held one are one group, the rest group by their bytes."""
    disputed = checked.filter(~F.col("same")).select("digest").distinct()
    inside = checked.select("id", "sha", "digest", "file", "row", "same").join(disputed, "digest", "left_semi")
    place = F.struct("id", "file", "row")
    largest = [F.count(F.lit(1)).alias("group_size"), F.max(place).alias("holder")]
    alike = inside.filter("same").join(inside.filter("same").groupBy("digest").agg(*largest), "digest")
    others = rows.join(inside.filter(~F.col("same")).select("file", "row"), ["file", "row"], "left_semi")
    others = others.join(others.groupBy("digest", "body").agg(*largest), ["digest", "body"])
    parts = [d.select("id", F.col("holder.id").alias("keep_id"), "group_size", (place == F.col("holder")).alias("kept"), "sha")
             for d in (alike, others)]
    settled = checked.join(disputed, "digest", "left_anti").select("id", "keep_id", "group_size", "kept", "sha")
    return settled.unionByName(parts[0]).unionByName(parts[1])


def deduplicate(
    spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", folder: str | None = None,
    digest_chars: int = 64, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row per row of the Parquet table at `path` (a folder or pattern): key, keep_id, group_size, kept, text_sha256.

    Texts are equal if all their bytes are; a null text counts as empty. The row
    with the largest key stays, null keys being smallest; among rows of one key,
    repeated ones too, the last by file and row, so exactly one row of a group is
    kept. Other columns are not read. An empty table gives no rows.

    With `folder` the state stays there and the next run adds new files to it;
    `digest_chars`, the hex digits of SHA-256 used as the key of the state, must
    then be the same, an even number. Without it the state goes at the end.
    """
    own = f"{shared_folder(spark)}/surco-{uuid.uuid4().hex}"
    held_at, seen_at, checked_at = f"{own}/held", f"{own}/seen", f"{own}/checked"
    state_at = folder or f"{own}/state"
    hold(spark, path, state_at, key, text, digest_chars, batch_bytes).write.parquet(held_at)
    if folder is None:
        removed(spark, state_at)
    held = spark.read.parquet(held_at)
    if held.isEmpty():
        kind = spark.read.parquet(path).schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"`{key}` {kind}, keep_id {kind}, group_size long, kept boolean, text_sha256 string")
    rows = _rows(spark.read.parquet(path), key, text, digest_chars)
    _seen(rows, held, int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(seen_at)
    removed(spark, held_at)
    _checked(spark.read.parquet(seen_at)).write.parquet(checked_at)
    removed(spark, seen_at)
    checked = spark.read.parquet(checked_at)
    named: list[Column] = [F.col("id").alias(key), F.col("keep_id"), F.col("group_size"), F.col("kept"), F.col("sha").alias("text_sha256")]
    if checked.filter(~F.col("same")).isEmpty():
        return checked.select(*named)
    return _regrouped(checked, rows).select(*named)
