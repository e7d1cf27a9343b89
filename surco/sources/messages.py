"""Message streams: reading them and parsing their bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import lat_lon_text, nth_number
from . import schemas


def kafka_messages(spark: SparkSession, servers: str, topic: str, starting: str = "latest", **options) -> DataFrame:
    """Unbounded messages of one topic, headers as attributes."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .option("includeHeaders", "true")
        .options(**options)
        .load()
    )
    place = F.concat_ws(":", "topic", "partition", F.lpad(F.col("offset").cast("string"), 20, "0"))
    return raw.select(
        header_map("headers").alias("attrs"),
        F.col("value").alias("data"),
        F.col("timestamp").alias("publish_ts"),
        place.alias("message_id"),
    )


def header_map(headers: str) -> Column:
    """Headers (key, value as bytes) as attributes: of a repeated key the last value counts, a header without key not at all.

    No headers give an empty map, so that a message of another kind still passes.
    """
    kind = "array<struct<key:string,value:string>>"
    named = F.filter(F.coalesce(F.transform(headers, lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value"))), F.array().cast(kind)),
                     lambda h: h["key"].isNotNull())
    keys = F.transform(named, lambda h: h["key"])
    # A header stays if its key does not come again behind it.
    last = F.filter(named, lambda h, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), h["key"]))
    return F.map_from_entries(last)


def file_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Unbounded messages landed as parquet files of the same columns."""
    reader = spark.readStream.schema(schemas.MESSAGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _utf8(data: str) -> Column:
    """Text of a message body, null where the bytes are no UTF-8."""
    return F.try_validate_utf8(F.col(data).cast("string"))


def parse_messages(raw: DataFrame, attrs: bool = True) -> tuple[DataFrame, DataFrame]:
    """Flat readings, and the rows whose body could not be read with the reason why.

    Event time is the publish time. With `attrs` the entity comes from the
    message attributes, without them from the body.
    """
    body = schemas.READING_BODY if attrs else schemas.PUSHED_BODY
    first = "valor" if attrs else "value"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    texts = raw.withColumn("_text", _utf8("data"))
    # Unfolding a one-element array keeps the filters below from parsing the JSON again.
    parsed = texts.select("*", F.explode(F.array(F.from_json("_text", body + ", _broken string", options))).alias("_body"))
    reason = (
        F.when(F.col("_text").isNull(), F.lit("no body"))
        .when(F.col("_body").isNull() | F.col("_body._broken").isNotNull(), F.lit("broken json"))
    )
    if attrs:
        reason = reason.when(F.col("attrs").isNull(), F.lit("no attributes"))
        fields = {
            "entity_type": F.try_element_at("attrs", F.lit("entity_type")),
            "entity_id": F.try_element_at("attrs", F.lit("entity_id")),
            "sensor_tipo": F.try_element_at("attrs", F.lit("sensor_tipo")),
            "user_id": F.try_element_at("attrs", F.lit("usuario_id")),
            "sensor_id": F.col("_body.sensor_entity_id"),
        }
    else:
        reason = reason.when(F.col("_body.parcela_usuario_id").isNull(), F.lit("no parcel"))
        fields = {
            "entity_type": F.lit("parcela"),
            "entity_id": F.col("_body.parcela_usuario_id"),
            "sensor_tipo": F.col("_body.sensor_type"),
            "user_id": F.col("_body.user_id"),
            "sensor_id": F.col("_body.sensor_id"),
        }
    fields["valor"] = F.col("_body")[first]
    checked = parsed.withColumn("_reason", reason)
    ok = checked.filter(F.col("_reason").isNull()).select(
        *[c.alias(n) for n, c in fields.items()],
        F.col("publish_ts").alias("event_time"),
        "message_id",
    )
    quarantine = checked.filter(F.col("_reason").isNotNull()).select(
        "message_id", "publish_ts", F.col("_text").alias("data"), F.col("_reason").alias("reason")
    )
    return ok, quarantine


def parse_positions(raw: DataFrame, role: str) -> DataFrame:
    """Position messages of one role; rows without usable coordinates drop out."""
    body = F.from_json(_utf8("data"), schemas.POSITION_BODY)
    rows = raw.select(body.alias("b"), F.col("publish_ts").alias("event_time"), "message_id")
    return with_lat_lon(
        rows.select(
            F.trim("b.user_id").alias("user_id"),
            lat_lon_text("b.coordinates").alias("coordinates"),
            F.col("b.timestamp").alias("timestamp"),
            F.lit(role).alias("tipo"),
            "event_time",
            "message_id",
        )
    )


def with_lat_lon(df: DataFrame, text: str = "coordinates") -> DataFrame:
    """Add lat and lon read from "lat,lon"; rows without both drop out."""
    pair = F.struct(nth_number(text, 0).alias("lat"), nth_number(text, 1).alias("lon"))
    # Unfolding a one-element array keeps the filter from reading the text again.
    return df.select("*", F.inline(F.array(pair))).filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def message_columns(attrs: dict[str, Column], body: Column, ts: Column, message_id: Column) -> list[Column]:
    """Columns that build a message row out of a table."""
    pairs = [x for k, v in attrs.items() for x in (F.lit(k), v)]
    return [
        F.create_map(*pairs).alias("attrs"),
        F.encode(body, "UTF-8").alias("data"),
        ts.alias("publish_ts"),
        message_id.alias("message_id"),
    ]
