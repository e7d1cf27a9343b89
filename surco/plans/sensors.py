"""Queries over readings: windows, baselines, plants, parsing, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, ntz, parcel_key, zero_to_null
from ..functions.fixed_values import DEVICE_CLASSES, METRICS, SWITCHABLE_DOMAINS
from ..operators import nesting, readings as rd, weather
from ..sources.messages import message_columns, parse_messages
from ..sources.tables import load, parcel_dimension
from . import roles
from .registry import query
from .roles import AS_OF, DAY_AS_OF, K_SQL, rounded

WINDOW_MEANS = ", ".join(f"avg(valor) FILTER (WHERE sensor_tipo = '{m}') AS {m}" for m in METRICS)


@query(f"""
WITH {roles.READINGS}, {roles.PARCELS}, hourly AS (
  SELECT entity_id, date_trunc('hour', event_time) AS "timestamp",
         arg_min(user_id, row(event_time, message_id)) AS user_id,
         {", ".join(f"round(avg(valor) FILTER (WHERE sensor_tipo = '{m}'), 4) AS {m}" for m in METRICS)}
  FROM readings GROUP BY ALL)
SELECT h.user_id, p.parcela_id AS parcel_id, "timestamp", temperatura, humedad_ambiental, humedad_suelo,
       CAST(NULL AS DOUBLE) AS precipitacion_mm, CAST(NULL AS DOUBLE) AS et0, CAST(NULL AS DOUBLE) AS radiacion_solar,
       CASE WHEN temperatura IS NOT NULL THEN 'sensor' END AS fuente_temperatura,
       p.cultivo AS tipo_cultivo, p.variedad, CAST(NULL AS DATE) AS fecha_plantacion_aprox
FROM hourly h LEFT JOIN parcels p ON CAST(p.id AS VARCHAR) = h.entity_id
WHERE coalesce(temperatura, humedad_ambiental, humedad_suelo) IS NOT NULL
""")
def sensor_hourly_pivot(spark: SparkSession, d: str) -> DataFrame:
    pivoted = rd.sensor_pivot(roles.readings(spark, d), every="1 hour")
    return rd.field_rows(pivoted, parcel_dimension(roles.parcels(spark, d)))


def parcel_weather(spark: SparkSession, d: str) -> DataFrame:
    named = roles.stations(spark, d).withColumn("entity_id", F.col("id").cast("string")).withColumn(
        "user_id", F.col("usuario_id").cast("string")
    )
    return weather.join_weather(named, roles.forecast(spark, d), DAY_AS_OF, ["o_orderkey"])


def ticks_of(events: DataFrame) -> DataFrame:
    """A tick in every ten-minute window from the first to the last event: `event_time`, `message_id`."""
    start = F.window("ts", "10 minutes")["start"].cast("timestamp_ntz").alias("at")
    bounds = events.select(start).agg(F.struct(F.min("at").alias("first"), F.max("at").alias("last")).alias("bounds"))
    windows = rd.window_spine(bounds, F.col("bounds")).select(F.explode("windows").alias("event_time"))
    return windows.select("event_time", F.unix_seconds(F.col("event_time").cast("timestamp")).alias("message_id"))


BASELINE_ROWS = f"""
WITH {roles.AT_STATIONS}, {roles.READINGS.replace("FROM events", "FROM at_stations")}, {roles.STATIONS}, {roles.LATEST_WEATHER}, ticks AS (
  SELECT unnest(generate_series(time_bucket(INTERVAL '10 minutes', min(ts)), time_bucket(INTERVAL '10 minutes', max(ts)), INTERVAL '10 minutes')) AS "timestamp"
  FROM events),
windows AS (
  SELECT entity_id, time_bucket(INTERVAL '10 minutes', event_time) AS "timestamp",
         arg_min(sensor_id, row(event_time, message_id)) FILTER (WHERE sensor_id <> '') AS sensor_id,
         {", ".join(f"avg(valor) FILTER (WHERE sensor_tipo = '{m}') AS s_{m}" for m in METRICS)}
  FROM readings GROUP BY ALL),
rows_ AS (
  SELECT CAST(p.usuario_id AS VARCHAR) AS user_id, CAST(p.id AS VARCHAR) AS parcel_id, p.nombre, t."timestamp",
         round(coalesce(s_temperatura, p.temperatura), 6) AS temperatura,
         round(coalesce(s_humedad_ambiental, p.humedad_ambiental), 6) AS humedad_ambiental,
         round(s_humedad_suelo, 6) AS humedad_suelo, round(p.precipitacion_mm, 6) AS precipitacion_mm,
         round(p.et0, 6) AS et0, round(p.radiacion_solar, 6) AS radiacion_solar,
         CASE WHEN s_temperatura IS NOT NULL THEN 'sensor' ELSE 'openmeteo' END AS fuente_temperatura,
         p.cultivo AS tipo_cultivo, p.variedad, CAST(NULL AS DATE) AS fecha_plantacion_aprox,
         p.estado_cielo, w.sensor_id
  FROM parcel_weather p CROSS JOIN ticks t LEFT JOIN windows w ON w.entity_id = CAST(p.id AS VARCHAR) AND w."timestamp" = t."timestamp")
"""


@query(BASELINE_ROWS + "SELECT * FROM rows_")
def sensor_10min_baseline_merge(spark: SparkSession, d: str) -> DataFrame:
    """Every field with a station in every window, from that of the first event to that of the last."""
    events = load(spark, d, "events")
    ticked = events.select(F.window("ts", "10 minutes")["start"].cast("timestamp_ntz").alias("timestamp"))
    sensors = rd.sensor_windows(roles.readings_of(roles.at_stations(events)))
    return rounded(rd.override_baseline(sensors, ticked, parcel_weather(spark, d)))


@query(f"""
WITH {roles.HOUSE_READINGS}, fanned AS (
  SELECT o.o_orderkey AS plant_id, r.sensor_tipo, r.valor, r.event_time FROM house_readings r
  JOIN orders o ON r.entity_type = 'invernadero' AND r.entity_id = CAST(o.o_custkey AS VARCHAR)
  UNION ALL
  SELECT o.o_orderkey, r.sensor_tipo, r.valor, r.event_time FROM house_readings r
  JOIN orders o ON r.entity_type = 'planta' AND r.entity_id = CAST(o.o_orderkey AS VARCHAR)),
means AS (
  SELECT plant_id, time_bucket(INTERVAL '5 minutes', event_time) AS "timestamp", {WINDOW_MEANS}
  FROM fanned GROUP BY ALL)
SELECT CAST(c.c_nationkey AS VARCHAR) AS user_id, CAST(o.o_custkey AS VARCHAR) AS greenhouse_id,
       CAST(plant_id AS VARCHAR) AS plant_id, "timestamp", round(temperatura, 6) AS temperatura,
       round(humedad_ambiental, 6) AS humedad_ambiental, round(humedad_suelo, 6) AS humedad_suelo,
       o.o_orderpriority AS tipo_cultivo, o.o_orderstatus AS variedad, CAST(NULL AS DATE) AS fecha_plantacion
FROM means JOIN orders o ON o.o_orderkey = plant_id LEFT JOIN customer c ON c.c_custkey = o.o_custkey
""")
def plant_5min_fanout(spark: SparkSession, d: str) -> DataFrame:
    out = rd.fanout_mean(
        roles.house_readings(spark, d), roles.greenhouses(spark, d), roles.plants(spark, d), "5 minutes"
    )
    return rounded(out)


# ---- messages -------------------------------------------------------------

def messages(spark: SparkSession, d: str) -> DataFrame:
    return messages_of(load(spark, d, "events"))


def messages_of(events: DataFrame) -> DataFrame:
    """Events as messages; errors come with a broken body, signups without attributes."""
    attrs = {
        "entity_type": F.lit("parcela"),
        "entity_id": F.col("user_id").cast("string"),
        "usuario_id": F.concat(F.lit("u"), roles.k().cast("string")),
        "sensor_tipo": roles.metric(),
    }
    whole = F.to_json(F.struct(
        F.col("value").alias("valor"),
        F.concat(F.lit("s"), roles.k().cast("string")).alias("sensor_entity_id"),
    ))
    body = F.when(F.col("event_type") == "error", F.lit('{"valor": ')).otherwise(whole)
    rows = events.select(
        "event_type", *message_columns(attrs, body, F.col("ts"), F.col("event_id").cast("string"))
    )
    no_attrs = F.when(F.col("event_type") != "signup", F.col("attrs"))
    return rows.withColumn("attrs", no_attrs).drop("event_type")


@query(f"""
SELECT 'parcela' AS entity_type, CAST(user_id AS VARCHAR) AS entity_id, {roles.METRIC_CASE} AS sensor_tipo,
       'u' || {K_SQL} AS user_id, 's' || {K_SQL} AS sensor_id, value AS valor, ts AS event_time,
       CAST(event_id AS VARCHAR) AS message_id
FROM events WHERE event_type NOT IN ('error', 'signup')
""")
def parse_attribute_messages(spark: SparkSession, d: str) -> DataFrame:
    ok, _ = parse_messages(messages(spark, d))
    return rd.coerce_numeric(ok)


@query("""
SELECT CAST(event_id AS VARCHAR) AS message_id, ts AS publish_ts,
       CASE event_type WHEN 'error' THEN 'broken json' ELSE 'no attributes' END AS reason
FROM events WHERE event_type IN ('error', 'signup')
""")
def message_quarantine(spark: SparkSession, d: str) -> DataFrame:
    _, bad = parse_messages(messages(spark, d))
    return bad.select("message_id", "publish_ts", "reason")


V1_CASE = (
    "CASE event_type WHEN 'view' THEN 'temperature' WHEN 'click' THEN 'ambient_humidity' "
    "WHEN 'purchase' THEN 'soil_moisture' ELSE event_type END"
)


@query(f"""
SELECT CAST(user_id AS VARCHAR) AS entity_id, {V1_CASE} AS sensor_tipo, value AS valor,
       CAST(event_id AS VARCHAR) AS message_id
FROM events WHERE event_type NOT IN ('error', 'signup')
""")
def parse_body_messages(spark: SparkSession, d: str) -> DataFrame:
    ok, _ = parse_messages(body_messages_of(load(spark, d, "events")), attrs=False)
    numeric, _ = rd.drop_non_numeric(ok)
    return numeric.select("entity_id", "sensor_tipo", "valor", "message_id")


def body_messages_of(events: DataFrame) -> DataFrame:
    """Body-only messages; errors carry text for a value, signups no parcel."""
    kind = roles.pick("event_type", view="temperature", click="ambient_humidity", purchase="soil_moisture")
    value = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    body = F.to_json(F.struct(
        F.col("user_id").cast("string").alias("sensor_id"),
        kind.alias("sensor_type"),
        F.when(F.col("event_type") != "signup", F.col("user_id")).alias("parcela_usuario_id"),
        F.col("user_id"), value.alias("value"),
    ))
    return events.select(
        F.encode(body, "UTF-8").alias("data"), F.col("ts").alias("publish_ts"),
        F.col("event_id").cast("string").alias("message_id"),
    )


@query(f"""
SELECT event_id, {roles.METRIC_CASE} AS sensor_tipo FROM events
""")
def vocabulary_map(spark: SparkSession, d: str) -> DataFrame:
    kind = roles.pick("event_type", view="temperature", click="ambient_humidity", purchase="soil_moisture")
    rows = load(spark, d, "events").select("event_id", kind.alias("sensor_tipo"))
    return rd.map_vocabulary(rows, "sensor_tipo")


@query(f"""
SELECT event_id, {V1_CASE} AS device_class FROM events WHERE event_type IN ('view', 'click', 'purchase')
""")
def device_class_map(spark: SparkSession, d: str) -> DataFrame:
    kind = roles.pick("event_type", view="temperature", click="humidity", purchase="moisture")
    rows = load(spark, d, "events").select("event_id", kind.alias("device_class"))
    return rd.map_vocabulary(rows, "device_class", DEVICE_CLASSES, keep_unknown=False)


@query("""
SELECT event_id, CASE event_type WHEN 'view' THEN 'switch' WHEN 'click' THEN 'valve' ELSE 'light' END
       || '.' || user_id AS entity_id,
       CASE event_type WHEN 'view' THEN 'switch' WHEN 'click' THEN 'valve' ELSE 'light' END AS domain
FROM events WHERE event_type IN ('view', 'click', 'signup')
""")
def device_domain_filter(spark: SparkSession, d: str) -> DataFrame:
    """Purchases stand for sensors, errors for ids without a domain."""
    domain = roles.pick("event_type", view="switch.", click="valve.", signup="light.", purchase="sensor.", error="")
    rows = load(spark, d, "events").select(
        "event_id", F.concat(domain, F.col("user_id").cast("string")).alias("entity_id")
    )
    return rd.filter_domain(rows, SWITCHABLE_DOMAINS)


# ---- registry -------------------------------------------------------------

def sensors(spark: SparkSession, d: str) -> DataFrame:
    """Sensor registry: one per order, connected through its customer."""
    kind = F.get(F.array(*[F.lit(x) for x in ("temperature", "ambient_humidity", "soil_moisture", "valve")]),
                 (F.col("o_orderkey") % 4).cast("int"))
    return load(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("sensor_id"),
        F.col("o_custkey").alias("connection_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("location_id"),
        F.lit("parcela").alias("location_type"),
        kind.alias("sensor_type"),
        (F.col("o_orderstatus") != "F").alias("active"),
    )


SENSORS = """sensors AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS sensor_id, o_custkey AS connection_id, CAST(o_custkey AS VARCHAR) AS user_id,
         CAST(o_orderkey AS VARCHAR) AS location_id, 'parcela' AS location_type,
         ['temperature', 'ambient_humidity', 'soil_moisture', 'valve'][o_orderkey % 4 + 1] AS sensor_type,
         o_orderstatus <> 'F' AS active
  FROM orders)"""


def connections(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("ha_url"))


@query(f"""
WITH {SENSORS}
SELECT connection_id, c_name AS ha_url, sensor_id, sensor_type, location_id, location_type, user_id
FROM sensors JOIN customer ON c_custkey = connection_id WHERE active
""")
def active_registry(spark: SparkSession, d: str) -> DataFrame:
    return rd.active_sensors(sensors(spark, d), connections(spark, d))


@query(f"""
WITH {SENSORS}
SELECT connection_id, c_name AS ha_url, sensor_id, sensor_type, location_id, location_type, user_id
FROM sensors JOIN customer ON c_custkey = connection_id WHERE active
""")
def connection_batches(spark: SparkSession, d: str) -> DataFrame:
    """What a poll asks for over every connection: all its active sensors."""
    return nesting.sensors_by_connection(rd.active_sensors(sensors(spark, d), connections(spark, d)))


@query(f"""
WITH {SENSORS}
SELECT s.location_type AS entity_type, s.location_id AS entity_id, s.user_id,
       CASE s.sensor_type WHEN 'temperature' THEN 'temperatura' WHEN 'ambient_humidity' THEN 'humedad_ambiental'
            WHEN 'soil_moisture' THEN 'humedad_suelo' ELSE s.sensor_type END AS sensor_tipo,
       e.value AS valor, 'u' AS unidad, s.sensor_id, TIMESTAMP '{AS_OF}' AS timestamp_lectura
FROM events e JOIN sensors s ON s.sensor_id = CAST(e.event_id AS VARCHAR) JOIN customer ON c_custkey = s.connection_id
WHERE s.active AND e.event_type NOT IN ('error', 'signup')
""")
def states_to_readings(spark: SparkSession, d: str) -> DataFrame:
    """Events as device states; errors are unavailable, signups no number."""
    state = (
        F.when(F.col("event_type") == "error", F.lit("unavailable"))
        .when(F.col("event_type") == "signup", F.lit("on"))
        .otherwise(F.col("value").cast("string"))
    )
    states = load(spark, d, "events").select(
        F.col("event_id").cast("string").alias("entity_id"), state.alias("state"),
        F.struct(F.lit("u").alias("unit_of_measurement")).alias("attributes"),
    )
    registry = rd.active_sensors(sensors(spark, d), connections(spark, d))
    return rd.states_to_readings(states, registry, ntz(AS_OF))


@query(f"""
WITH {SENSORS}, pushed AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS sensor_id,
         CASE WHEN event_type <> 'error' THEN CAST({K_SQL} AS VARCHAR) END AS value FROM events)
SELECT event_id, p.sensor_id, value, s.sensor_type, s.location_id AS parcela_usuario_id,
       CASE WHEN value IS NULL THEN 'sensor_id and value are required'
            WHEN s.sensor_id IS NULL THEN 'sensor not registered or inactive' END AS reason
FROM pushed p LEFT JOIN sensors s ON s.sensor_id = p.sensor_id AND s.active AND value IS NOT NULL
""")
def pushed_readings(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_type") != "error", roles.k().cast("string"))
    rows = load(spark, d, "events").select(
        "event_id", F.col("event_id").cast("string").alias("sensor_id"), value.alias("value")
    )
    ok, bad = rd.attach_registry(rows, sensors(spark, d))
    both = ok.drop("user_id").unionByName(bad, allowMissingColumns=True)
    return both.withColumn("parcela_usuario_id", F.col("parcela_usuario_id").cast("string"))


@query(f"""
WITH {roles.PARCELS}
SELECT id, provincia || '-' || municipio || '-None-' || (id % 7) || '-' || usuario_id AS clave,
       CASE WHEN cultivo <> 'MACHINERY' THEN trim(nombre) END AS nombre,
       nullif(superficie, 0) AS superficie, codigo_ine
FROM parcels
""")
def parcel_keys(spark: SparkSession, d: str) -> DataFrame:
    p = roles.parcels(spark, d)
    spaced = F.when(F.col("cultivo") == "MACHINERY", F.lit("  ")).otherwise(F.concat(F.lit(" "), "nombre", F.lit(" ")))
    nothing: Column = F.lit(None).cast("int")
    return p.select(
        "id",
        parcel_key("provincia", "municipio", nothing, F.col("id") % 7, "usuario_id").alias("clave"),
        blank_to_null(spaced).alias("nombre"),
        zero_to_null("superficie").alias("superficie"),
        weather.ine_code("provincia", "municipio").alias("codigo_ine"),
    )


@query(f"""
WITH {roles.PARCELS}
SELECT id // 7 AS usuario_id,
       '- ' || CASE WHEN cultivo = 'MACHINERY' THEN '?' ELSE nombre END || ' (' || cultivo || ') → ID: ' || parcela_id AS linea
FROM parcels
""")
def parcel_list_text(spark: SparkSession, d: str) -> DataFrame:
    p = roles.parcels(spark, d)
    named = p.withColumn("nombre", F.when(F.col("cultivo") != "MACHINERY", F.col("nombre")))
    owned = named.withColumn("usuario_id", F.floor(F.col("id") / 7).cast("bigint"))
    return nesting.parcel_lines(owned)
