"""Running the sensor and position streams.

Event time is the publish time of the message. Windows close when the
watermark passes their end; the default delay of zero drops what comes later.
A closed window is finished per batch: dimensions are joined as they are now,
facts are appended and latest values stored, all repeatable by batch number.
A batch that only closes windows has no new input, and Spark takes its rows for
that few: joins are planned by sizes measured at their shuffles instead.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from contextlib import AbstractContextManager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import ntz
from ..functions.fixed_values import METRICS
from ..operators import proximity, readings as rd, weather
from ..session import removed, settings, shared_folder
from ..sources.messages import parse_messages
from ..sources.tables import append_facts
from .state import StateLog

Load = Callable[[], DataFrame]

# Window and refresh lengths of the streams.
HOURLY = ("1 hour", 3600)
FIELD = ("10 minutes", 600)
PLANT = ("5 minutes", 300)
NEARBY = ("15 seconds", 900)


# For a session whose open windows may outgrow the heap: they lie on disk, behind a bounded cache per executor.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else every partition of the state takes 4 MB of disk in advance, and every write reads first to count.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


class Refreshed:
    """A dimension that is loaded again once it is older than its interval.

    It is loaded before the first use, so nothing runs against an empty
    dimension. A load reads all rows and writes them to the shared folder; one
    that fails, also while reading, leaves the last good rows in place and counts
    in `failures`. The last two loads stay, so a batch that began with the former
    one can end; older ones are removed.
    """

    def __init__(self, load: Load, seconds: float, clock: Callable[[], float] = time.monotonic) -> None:
        self._load, self._seconds, self._clock = load, seconds, clock
        self._held: DataFrame | None = None
        self._path = ""
        self._at = 0.0
        self._folders: list[str] = []
        self.failures = 0

    def get(self, spark: SparkSession | None = None) -> DataFrame:
        """The rows, in the session they were loaded in or another of the same context."""
        now = self._clock()
        if self._held is None or now - self._at >= self._seconds:
            try:
                self._held, self._at = self._snapshot(), now
            except Exception:
                if self._held is None:
                    raise
                self.failures += 1
        return self._held if spark is None else spark.read.schema(self._held.schema).parquet(self._path)

    def _snapshot(self) -> DataFrame:
        rows = self._load()
        spark = rows.sparkSession
        path = f"{shared_folder(spark)}/dimension-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(path)
        except Exception:
            removed(spark, path)
            raise
        self._folders.append(path)
        while len(self._folders) > 2:
            removed(spark, self._folders.pop(0))
        self._path = path
        return spark.read.schema(rows.schema).parquet(path)


def watermarked(stream: DataFrame, delay: str = "0 seconds") -> DataFrame:
    return stream.withWatermark("event_time", delay)


def closed_windows(stream: DataFrame, every: str) -> DataFrame:
    """Rows of a stream, passed on once their window has closed.

    A batch then holds whole windows and can use any batch operator. A message
    that was delivered twice comes out once.
    """
    plain = [c for c in stream.columns if c != "event_time"]
    # The cast takes the watermark off the copy, the window keeps it.
    held = stream.withColumn("_at", F.col("event_time").cast("timestamp_ntz"))
    rows = held.groupBy(F.window("event_time", every).alias("w"), "_at", *plain).agg(F.count(F.lit(1)).alias("_n"))
    return rows.select(*plain, F.col("_at").alias("event_time"))


def measured_sizes(spark: SparkSession, adaptive: str = "true") -> AbstractContextManager[None]:
    """What is planned inside broadcasts a side only for the size its shuffle had, not for an estimate; afterwards the session is as it was.

    A stream turns adaptive execution off in its own session, also for what a batch does with its rows; `adaptive` is as its owner set it.
    """
    limit, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    return settings(spark, {"spark.sql.adaptive.enabled": adaptive, measured: spark.conf.get(measured, None) or spark.conf.get(limit), limit: "-1"})


def start(stream: DataFrame, name: str, each_batch: Callable[[DataFrame, int], None],
          checkpoint: str | None = None, every: str | None = None) -> StreamingQuery:
    """Run a stream; without an interval it works off what is there and stops."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
        raise ValueError("streams need spark.sql.session.timeZone=UTC")
    place = checkpoint or f"{shared_folder(spark)}/{name}"
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")

    def run_batch(batch: DataFrame, number: int) -> None:
        with measured_sizes(batch.sparkSession, adaptive):
            each_batch(batch, number)

    writer = (
        stream.writeStream.queryName(name).outputMode("append")
        .foreachBatch(run_batch).option("checkpointLocation", place)
    )
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def quarantine(messages: DataFrame, path: str, attrs: bool = True, checkpoint: str | None = None,
               every: str | None = None) -> StreamingQuery:
    """Messages that could not be read, with the reason."""
    _, bad = parse_messages(messages, attrs)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/lote={number}")

    return start(bad, "quarantine", store, checkpoint, every)


def numeric_readings(messages: DataFrame, attrs: bool = True, delay: str = "0 seconds") -> DataFrame:
    ok, _ = parse_messages(messages, attrs)
    return watermarked(rd.coerce_numeric(ok), delay)


# ---- fields, hourly -------------------------------------------------------

# Sensor types of the older messages.
V1_TYPES = {"temperatura": "temperature", "humedad_ambiental": "ambient_humidity", "humedad_suelo": "soil_moisture"}


def hourly_fields(messages: DataFrame, parcels: Load, facts: str, delay: str = "0 seconds",
                  checkpoint: str | None = None, every: str | None = None) -> StreamingQuery:
    """Body-only messages to hourly field rows."""
    window, refresh = HOURLY
    known = Refreshed(parcels, refresh)
    pivoted = rd.sensor_pivot(numeric_readings(messages, False, delay), every=window, types=V1_TYPES)

    def finish(batch: DataFrame, number: int) -> None:
        rows = _plain(rd.field_rows(batch, known.get()))
        append_facts(rows, facts, "parcel_id", batch=number)

    return start(pivoted, "hourly_fields", finish, checkpoint, every)


def _plain(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Warehouse timestamps carry no zone."""
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


# ---- fields, ten minutes over a weather baseline --------------------------

# Rows that one task of the baseline unfolds and writes.
FACTS_PER_TASK = 500_000

# Fields of the state document.
FIELD_STATE = (
    "temperatura", "humedad_ambiental", "humedad_suelo", "precipitacion_mm", "et0",
    "radiacion_solar", "estado_cielo", "fuente_temperatura",
)


def field_state(path: str) -> StateLog:
    """Latest values per field; a null leaves the stored value alone."""
    return StateLog(path, ["user_id", "parcel_id"], [*FIELD_STATE, "updated_at"], ["timestamp"], skip_nulls=True)


def baseline_fields(messages: DataFrame, ticks: DataFrame, parcels_weather: Load, facts: str, state: StateLog,
                    as_of: Column | None = None, delay: str = "0 seconds", checkpoint: str | None = None,
                    every: str | None = None) -> StreamingQuery:
    """Field rows every ten minutes for every parcel, sensors over weather.

    `ticks` is a stream of (event_time, message_id). Sensor averages and ticks
    share one windowed aggregate, so both close together; the parcels join
    only after that and never enter the stream's state. A window closes once
    both streams have passed it: a source that falls silent holds it open.

    Parcel days are dealt and sorted before their windows unfold, to as many
    tasks as the rows ask for; the rows come out in the order of the facts and
    are not sorted again. The latest values are taken from the same days, from
    the windows that can hold them.
    """
    window, refresh = FIELD
    known = Refreshed(parcels_weather, refresh)
    ok, _ = parse_messages(messages)
    sensors = rd.coerce_numeric(rd.route(ok, ("parcela",)))
    # Each source has a watermark of its own, so the later of the two holds the windows open.
    closed = rd.baseline_windows(watermarked(sensors, delay), watermarked(ticks, delay), window)

    def finish(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        ticked, parcels = rows.filter("tick"), known.get(batch.sparkSession)
        days = _dealt_days(rd.baseline_days(rows.filter(~F.col("tick")), ticked, parcels), ticked, parcels).persist()
        append_facts(rd.unfold_days(days), facts, "parcel_id", batch=number, dealt=True, ordered=True)
        now = as_of if as_of is not None else F.current_timestamp().cast("timestamp_ntz")
        state.write(rd.unfold_days(days, latest=True).withColumn("updated_at", now), number)
        days.unpersist()
        rows.unpersist()

    return start(closed, "baseline_fields", finish, checkpoint, every)


def _dealt_days(days: DataFrame, ticked: DataFrame, parcels: DataFrame) -> DataFrame:
    """Parcel days by day and parcel, in tasks of about FACTS_PER_TASK windows: part of a day, or some whole days."""
    first, last = ticked.agg(F.min("timestamp"), F.max("timestamp")).first()
    if first is None:
        return days
    a_day = parcels.count() * min((last - first) // timedelta(minutes=10) + 1, 144) or 1
    parts, together = -(-a_day // FACTS_PER_TASK), max(FACTS_PER_TASK // a_day, 1)
    turn = F.floor(F.date_diff("_day", F.lit(first.date())) / together)
    part = F.coalesce(F.pmod(F.xxhash64("entity_id"), F.lit(parts)), F.lit(0))
    tasks = ((last.date() - first.date()).days // together + 1) * parts
    return days.repartitionById(tasks, (turn * parts + part).cast("int")).sortWithinPartitions("_day", "entity_id")


def parcels_with_weather(parcels: DataFrame, forecast: DataFrame, as_of) -> DataFrame:
    """The baseline dimension: parcels with the latest weather of their municipality."""
    named = parcels.select(
        F.col("id").cast("string").alias("entity_id"), F.col("usuario_id").cast("string").alias("user_id"),
        "provincia", "municipio", "cultivo", "variedad", "nombre",
    )
    return weather.join_weather(named, forecast, ntz(as_of))


# ---- plants ---------------------------------------------------------------

def plant_state(path: str) -> StateLog:
    """Latest value per greenhouse or plant and sensor; null counts as a value."""
    return StateLog(
        path, ["user_id", "greenhouse_id", "plant_id", "sensor_tipo"], ["valor", "updated_at"],
        ["event_time", "message_id"],
    )


def located(readings: DataFrame, members: DataFrame, greenhouses: DataFrame) -> DataFrame:
    """Readings of known greenhouses and plants with owner and place."""
    houses = greenhouses.select(
        F.col("id").cast("string").alias("entity_id"), F.col("id").cast("string").alias("greenhouse_id"),
        F.lit(None).cast("string").alias("plant_id"), F.col("usuario_id").cast("string").alias("user_id"),
        F.lit("invernadero").alias("entity_type"),
    )
    plants = members.select(
        F.col("plant_id").alias("entity_id"), "greenhouse_id", "plant_id", "user_id",
        F.lit("planta").alias("entity_type"),
    )
    places = houses.unionByName(plants)
    return readings.drop("user_id").join(places, ["entity_type", "entity_id"])


def plants(messages: DataFrame, greenhouses: Load, plants: Load, facts: str, delay: str = "0 seconds",
           checkpoint: str | None = None, every: str | None = None) -> StreamingQuery:
    """Greenhouse and plant messages to one row per plant and window.

    The stream's state holds partial sums per sensor entity; plants unfold
    when a window closes. The unfolded rows are shuffled once, by day and plant,
    and are summed and written where that puts them.
    """
    window, refresh = PLANT
    houses, members = Refreshed(greenhouses, refresh), Refreshed(plants, refresh)
    partials = rd.window_partials(numeric_readings(messages, True, delay), window)

    def finish(batch: DataFrame, number: int) -> None:
        rows = rd.fanout_partials(batch, rd.plants_with_owner(members.get(), houses.get()), by_day=True)
        append_facts(_plain(rows), facts, "plant_id", batch=number, dealt=True)

    return start(partials, "plants", finish, checkpoint, every)


def plant_values(messages: DataFrame, greenhouses: Load, plants: Load, state: StateLog,
                 as_of: Column | None = None, checkpoint: str | None = None,
                 every: str | None = None) -> StreamingQuery:
    """Every greenhouse or plant message to the latest-value table."""
    refresh = PLANT[1]
    houses, members = Refreshed(greenhouses, refresh), Refreshed(plants, refresh)
    ok, _ = parse_messages(messages)
    rows = rd.coerce_numeric(rd.route(ok, ("invernadero", "planta")))

    def finish(batch: DataFrame, number: int) -> None:
        owned = rd.plants_with_owner(members.get(), houses.get())
        now = as_of if as_of is not None else F.current_timestamp().cast("timestamp_ntz")
        state.write(located(batch, owned, houses.get()).withColumn("updated_at", now), number)

    return start(rows, "plant_values", finish, checkpoint, every)


# ---- proximity ------------------------------------------------------------

def nearby(victims: DataFrame, aggressors: DataFrame, relations: Load, zones: Load, facts: str,
           state_path: str, delay: str = "0 seconds", metric: str = "geodesic", window: str = NEARBY[0],
           checkpoint: str | None = None, every: str | None = None) -> StreamingQuery:
    """Two position streams to alert rows and the latest alert per pair."""
    links, places = Refreshed(relations, NEARBY[1]), Refreshed(zones, NEARBY[1])
    both = closed_windows(watermarked(victims, delay).unionByName(watermarked(aggressors, delay)), window)

    def finish(batch: DataFrame, number: int) -> None:
        alerts = proximity.proximity_alerts(batch, links.get(), places.get(), window, metric).persist()
        alerts.write.mode("overwrite").parquet(f"{facts.rstrip('/')}/lote={number}")
        alert_log(state_path).write(alerts.withColumn("doc_id", proximity.alert_key()), number)
        alerts.unpersist()

    return start(both, "nearby", finish, checkpoint, every)


def alert_log(path: str) -> StateLog:
    fields = [part.split()[0] for part in proximity.ALERTS.split(", ")]
    return StateLog(path, ["doc_id"], fields, ["timestamp"], skip_nulls=True)


# ---- pushed readings ------------------------------------------------------

def pushed(stream: DataFrame, registry: Load, accepted: str, rejected: str, refresh: float = 600,
           checkpoint: str | None = None, every: str | None = None) -> StreamingQuery:
    """Pushed (sensor_id, value) rows checked against the sensor registry."""
    known = Refreshed(registry, refresh)

    def finish(batch: DataFrame, number: int) -> None:
        ok, bad = rd.attach_registry(batch, known.get())
        ok.write.mode("overwrite").parquet(f"{accepted.rstrip('/')}/lote={number}")
        bad.write.mode("overwrite").parquet(f"{rejected.rstrip('/')}/lote={number}")

    return start(stream, "pushed", finish, checkpoint, every)


def ticks(spark: SparkSession, seconds: int) -> DataFrame:
    """One tick per interval, from the built-in rate source."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    beats = rate.filter(F.col("value") % seconds == 0)
    return beats.select(F.col("timestamp").alias("event_time"), F.col("value").cast("string").alias("message_id"))
