"""Streams over the given events, run to their end.

The events are read as a stream and worked off. Windows close when the
watermark passes their end, so a closing message per role is landed a day after
the last event; it belongs to no known entity.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ntz
from ..session import shared_folder
from ..sources.messages import message_columns
from ..sources.tables import parcel_dimension
from ..streaming import run
from . import geo, roles, sensors
from .keyed import HOUSE_STATE
from .registry import query
from .roles import AS_OF, rounded

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


class Run:
    """A session in UTC, the event stream in it, and a folder for one run."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.session.timeZone", "UTC")
        # As a pattern, since a stream source takes a folder or a pattern but no single file.
        self.source = f"{d.rstrip('/')}/events.parquet*"

        self.closing = f"{self.folder}/closing"
        after = self.session.read.schema(EVENTS).parquet(self.source).agg(F.max("ts").alias("ts"), F.max("event_id").alias("event_id"), F.max_by("props", "ts").alias("props"))
        roles_ = F.explode(F.array(F.lit("view"), F.lit("error")))
        after.select(
            (F.col("event_id") + 1).alias("event_id"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"),
            F.lit(-1).cast("bigint").alias("user_id"), roles_.alias("event_type"), F.lit(0.0).alias("value"), "props",
        ).filter(F.col("ts").isNotNull()).write.parquet(self.closing)

    def events(self) -> DataFrame:
        """The table as a stream, and the closing messages."""
        read = self.session.readStream.schema(EVENTS)
        return read.parquet(self.source).unionByName(read.parquet(f"{self.closing}*"))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"


def house_messages(events: DataFrame) -> DataFrame:
    """Greenhouse and plant readings as messages with attributes."""
    rows = roles.house_readings_of(events)
    attrs = {
        "entity_type": F.col("entity_type"), "entity_id": F.col("entity_id"), "usuario_id": F.col("user_id"),
        "sensor_tipo": F.col("sensor_tipo"),
    }
    body = F.to_json(F.struct("valor", F.col("sensor_id").alias("sensor_entity_id")))
    when = F.col("event_time").cast("timestamp")
    return rows.select(*message_columns(attrs, body, when, F.lpad(F.col("message_id").cast("string"), 20, "0")))


METRICS_SQL = ", ".join(
    f"round(avg(value) FILTER (WHERE event_type = '{e}'), 4) AS {m}"
    for e, m in (("view", "temperatura"), ("click", "humedad_ambiental"), ("purchase", "humedad_suelo"))
)


@query(f"""
WITH {roles.PARCELS}, seen AS (SELECT * FROM events WHERE event_type <> 'signup'), horas AS (
  SELECT user_id, date_trunc('hour', ts) AS "timestamp", {METRICS_SQL} FROM seen GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS user_id, p.parcela_id AS parcel_id, "timestamp", temperatura, humedad_ambiental,
       humedad_suelo, CASE WHEN temperatura IS NOT NULL THEN 'sensor' END AS fuente_temperatura, p.cultivo AS tipo_cultivo
FROM horas h LEFT JOIN parcels p ON p.id = h.user_id
WHERE coalesce(temperatura, humedad_ambiental, humedad_suelo) IS NOT NULL
""")
def stream_hourly_fields(spark: SparkSession, d: str) -> DataFrame:
    job = Run(spark, d)
    messages = sensors.body_messages_of(job.events())
    messages = messages.withColumn("publish_ts", F.col("publish_ts").cast("timestamp"))
    dims = lambda: parcel_dimension(roles.parcels(job.session, d))
    run.hourly_fields(messages, dims, job.path("facts"), checkpoint=job.path("checkpoint")).awaitTermination()
    return spark.read.parquet(job.path("facts")).select(
        "user_id", "parcel_id", "timestamp", "temperatura", "humedad_ambiental", "humedad_suelo",
        "fuente_temperatura", "tipo_cultivo",
    )


@query(f"""
WITH {roles.HOUSE_READINGS}, fanned AS (
  SELECT o.o_orderkey AS plant_id, r.sensor_tipo, r.valor, r.event_time FROM house_readings r
  JOIN orders o ON r.entity_type = 'invernadero' AND r.entity_id = CAST(o.o_custkey AS VARCHAR)
  UNION ALL
  SELECT o.o_orderkey, r.sensor_tipo, r.valor, r.event_time FROM house_readings r
  JOIN orders o ON r.entity_type = 'planta' AND r.entity_id = CAST(o.o_orderkey AS VARCHAR)),
means AS (
  SELECT plant_id, time_bucket(INTERVAL '5 minutes', event_time) AS "timestamp", {sensors.WINDOW_MEANS}
  FROM fanned GROUP BY ALL)
SELECT CAST(plant_id AS VARCHAR) AS plant_id, "timestamp", round(temperatura, 6) AS temperatura,
       round(humedad_ambiental, 6) AS humedad_ambiental, round(humedad_suelo, 6) AS humedad_suelo
FROM means
""")
def stream_plants(spark: SparkSession, d: str) -> DataFrame:
    job = Run(spark, d)
    run.plants(
        house_messages(job.events()), lambda: roles.greenhouses(job.session, d), lambda: roles.plants(job.session, d),
        job.path("facts"), checkpoint=job.path("checkpoint"),
    ).awaitTermination()
    facts = spark.read.parquet(job.path("facts"))
    return rounded(facts.select("plant_id", "timestamp", "temperatura", "humedad_ambiental", "humedad_suelo"))


@query(f"""
WITH {HOUSE_STATE}
SELECT user_id, greenhouse_id, plant_id, sensor_tipo, round(valor, 6) AS valor, TIMESTAMP '{AS_OF}' AS updated_at FROM house_state
""")
def stream_plant_state(spark: SparkSession, d: str) -> DataFrame:
    """Every message to the latest-value log, read back."""
    job = Run(spark, d)
    state = run.plant_state(job.path("state"))
    run.plant_values(
        house_messages(job.events()), lambda: roles.greenhouses(job.session, d), lambda: roles.plants(job.session, d),
        state, ntz(AS_OF), job.path("checkpoint"),
    ).awaitTermination()
    return rounded(state.read(spark))


@query(f"""
SELECT CAST(event_id AS VARCHAR) AS message_id, CASE event_type WHEN 'error' THEN 'broken json' ELSE 'no attributes' END AS reason
FROM events WHERE event_type IN ('error', 'signup')
""")
def stream_quarantine(spark: SparkSession, d: str) -> DataFrame:
    job = Run(spark, d)
    messages = sensors.messages_of(job.session.readStream.schema(EVENTS).parquet(job.source))
    run.quarantine(messages, job.path("bad"), checkpoint=job.path("checkpoint")).awaitTermination()
    return spark.read.parquet(job.path("bad")).select("message_id", "reason")


@query(geo.GEODESIC_ALERTS + geo.ALERT_SELECT)
def stream_nearby(spark: SparkSession, d: str) -> DataFrame:
    """Victims and aggressors as two streams."""
    job = Run(spark, d)

    def role(name: str) -> DataFrame:
        rows = geo.positions_of(job.events()).filter(F.col("tipo") == name)
        return rows.withColumn("event_time", F.col("event_time").cast("timestamp"))

    run.nearby(
        role("victima"), role("agresor"), lambda: geo.relations(job.session, d), lambda: geo.zones(job.session, d),
        job.path("facts"), job.path("state"), window=geo.EVERY, checkpoint=job.path("checkpoint"),
    ).awaitTermination()
    return rounded(spark.read.parquet(job.path("facts")).select(*geo.ALERT_COLUMNS))


def field_messages(events: DataFrame) -> DataFrame:
    """Field readings as messages with attributes."""
    rows = roles.readings_of(events)
    attrs = {"entity_type": F.col("entity_type"), "entity_id": F.col("entity_id"), "usuario_id": F.col("user_id"), "sensor_tipo": F.col("sensor_tipo")}
    body = F.to_json(F.struct("valor", F.col("sensor_id").alias("sensor_entity_id")))
    return rows.select(*message_columns(attrs, body, F.col("event_time").cast("timestamp"), F.lpad(F.col("message_id").cast("string"), 20, "0")))


def run_baseline(spark: SparkSession, d: str) -> tuple[Run, run.StateLog]:
    """Ticks and messages, to the end of both; facts and the field state are in the run's folder."""
    job = Run(spark, d)
    # All windows of the table are open until its end.
    for name, value in run.STATE_ON_DISK.items():
        job.session.conf.set(name, value)
    day = F.col("event_time").cast("timestamp")
    beats = sensors.ticks_of(job.session.read.schema(EVENTS).parquet(job.source)).unionByName(
        job.session.read.parquet(job.closing).select(F.col("ts").alias("event_time"), F.col("event_id").alias("message_id")))
    beats.select(day.alias("event_time"), F.lpad(F.col("message_id").cast("string"), 20, "0").alias("message_id")).write.parquet(job.path("ticks"))
    ticks = job.session.readStream.schema("event_time timestamp, message_id string").parquet(job.path("ticks") + "*")
    state = run.field_state(job.path("state"))
    run.baseline_fields(
        field_messages(roles.at_stations(job.events())), ticks, lambda: sensors.parcel_weather(job.session, d), job.path("facts"), state, ntz(AS_OF),
        checkpoint=job.path("checkpoint"),
    ).awaitTermination()
    return job, state


@query(sensors.BASELINE_ROWS + "SELECT * FROM rows_")
def stream_baseline_fields(spark: SparkSession, d: str) -> DataFrame:
    """Ten-minute field rows of every parcel, sensors over weather, from two streams."""
    job, _ = run_baseline(spark, d)
    return rounded(spark.read.parquet(job.path("facts")).drop("lote", "fecha"))


@query(sensors.BASELINE_ROWS + f"""
SELECT user_id, parcel_id,
       {", ".join(f'arg_max({c}, "timestamp") FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in run.FIELD_STATE)},
       TIMESTAMP '{AS_OF}' AS updated_at
FROM rows_ GROUP BY ALL
""")
def stream_field_state(spark: SparkSession, d: str) -> DataFrame:
    """The latest values of every parcel that the same run leaves behind."""
    _, state = run_baseline(spark, d)
    return rounded(state.read(spark))
