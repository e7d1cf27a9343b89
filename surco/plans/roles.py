"""The given tables in the roles the operators expect, in Spark and in SQL.

Amounts are divided by numbers such as 3.71828 so that averages do not fall on
rounding ties, where engines differ. Keys follow from keys, so that groups
keep their size as the tables grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import half_up, ine_code
from ..functions.fixed_values import SKY_BY_WEATHER_CODE
from ..sources.tables import load

DAY_AS_OF = "1999-06-30"
AS_OF = "2024-01-31 00:00:00"


def pick(column: str, **cases: str) -> Column:
    out = None
    for value, result in cases.items():
        test = F.col(column) == value
        out = F.when(test, F.lit(result)) if out is None else out.when(test, F.lit(result))
    return out.otherwise(F.col(column))


def k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


METRIC_CASE = (
    "CASE event_type WHEN 'view' THEN 'temperatura' WHEN 'click' THEN 'humedad_ambiental' "
    "WHEN 'purchase' THEN 'humedad_suelo' ELSE event_type END"
)
K_SQL = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def metric() -> Column:
    return pick("event_type", view="temperatura", click="humedad_ambiental", purchase="humedad_suelo")


def readings(spark: SparkSession, d: str) -> DataFrame:
    return readings_of(load(spark, d, "events"))


def readings_of(events: DataFrame) -> DataFrame:
    """Field readings: one per event, the user being the field."""
    return events.select(
        F.lit("parcela").alias("entity_type"),
        F.col("user_id").cast("string").alias("entity_id"),
        F.concat(F.lit("u"), k().cast("string")).alias("user_id"),
        metric().alias("sensor_tipo"),
        (F.col("value") / 3.71828).alias("valor"),
        F.when(k() % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("s"), k().cast("string"))).alias("sensor_id"),
        F.col("ts").alias("event_time"),
        F.col("event_id").alias("message_id"),
    )


READINGS = f"""readings AS (
  SELECT 'parcela' AS entity_type, CAST(user_id AS VARCHAR) AS entity_id, 'u' || {K_SQL} AS user_id,
         {METRIC_CASE} AS sensor_tipo, value / 3.71828 AS valor,
         CASE WHEN {K_SQL} % 3 = 0 THEN '' ELSE 's' || {K_SQL} END AS sensor_id,
         ts AS event_time, event_id AS message_id
  FROM events)"""


def house_readings(spark: SparkSession, d: str) -> DataFrame:
    return house_readings_of(load(spark, d, "events"))


def house_readings_of(events: DataFrame) -> DataFrame:
    """Air readings belong to the user's greenhouse, soil readings to the plant of the event."""
    soil = F.col("sensor_tipo") == "humedad_suelo"
    air = F.col("sensor_tipo").isin("temperatura", "humedad_ambiental")
    return (
        readings_of(events)
        .withColumn("entity_type", F.when(soil, F.lit("planta")).when(air, F.lit("invernadero")).otherwise(F.lit("parcela")))
        .withColumn("entity_id", F.when(soil, F.col("message_id").cast("string")).otherwise(F.col("entity_id")))
    )


HOUSE_READINGS = READINGS + """, house_readings AS (
  SELECT CASE WHEN sensor_tipo = 'humedad_suelo' THEN 'planta'
              WHEN sensor_tipo IN ('temperatura', 'humedad_ambiental') THEN 'invernadero'
              ELSE 'parcela' END AS entity_type,
         CASE WHEN sensor_tipo = 'humedad_suelo' THEN CAST(message_id AS VARCHAR) ELSE entity_id END AS entity_id,
         user_id, sensor_tipo, valor, event_time, message_id
  FROM readings)"""


def greenhouses(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("usuario_id"), F.col("c_name").alias("nombre")
    )


def plants(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("invernadero_id"),
        F.col("o_orderpriority").alias("tipo"), F.col("o_orderstatus").alias("variedad"),
    )


def parcels(spark: SparkSession, d: str) -> DataFrame:
    """Fields: one per customer. Province and municipality together are unique."""
    return load(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("usuario_id"),
        F.col("c_name").alias("parcela_id"),
        F.floor(F.col("c_custkey") / 1000).cast("int").alias("provincia"),
        (F.col("c_custkey") % 1000).cast("int").alias("municipio"),
        F.concat(F.lit("campo "), F.col("c_custkey").cast("string")).alias("nombre"),
        F.col("c_mktsegment").alias("cultivo"),
        F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("variedad"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") / 1370 + 38).alias("lat"),
        (F.col("c_acctbal") / 2130 - 3).alias("lng"),
        F.when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(F.col("c_acctbal")).alias("superficie"),
    )


PARCELS = """parcels AS (
  SELECT c_custkey AS id, c_nationkey AS usuario_id, c_name AS parcela_id,
         CAST(c_custkey // 1000 AS INTEGER) AS provincia, CAST(c_custkey % 1000 AS INTEGER) AS municipio,
         'campo ' || c_custkey AS nombre, c_mktsegment AS cultivo, 'v' || c_nationkey AS variedad,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal / 1370 + 38 END AS lat,
         c_acctbal / 2130 - 3 AS lng,
         CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS superficie,
         format('{:02d}{:03d}', CAST(c_custkey // 1000 AS INTEGER), CAST(c_custkey % 1000 AS INTEGER)) AS codigo_ine
  FROM customer)"""


def stations(spark: SparkSession, d: str) -> DataFrame:
    """Fields with a station: one per supplier, in the layout of `parcels`."""
    return load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("usuario_id"), F.col("s_name").alias("parcela_id"),
        F.floor(F.col("s_suppkey") / 1000).cast("int").alias("provincia"), (F.col("s_suppkey") % 1000).cast("int").alias("municipio"),
        F.concat(F.lit("campo "), F.col("s_suppkey").cast("string")).alias("nombre"),
        F.concat(F.lit("cultivo "), (F.col("s_suppkey") % 5).cast("string")).alias("cultivo"),
        F.concat(F.lit("v"), F.col("s_nationkey").cast("string")).alias("variedad"),
    )


STATIONS = """parcels AS (
  SELECT s_suppkey AS id, s_nationkey AS usuario_id, s_name AS parcela_id, 'campo ' || s_suppkey AS nombre,
         'cultivo ' || s_suppkey % 5 AS cultivo, 'v' || s_nationkey AS variedad,
         format('{:02d}{:03d}', CAST(s_suppkey // 1000 AS INTEGER), CAST(s_suppkey % 1000 AS INTEGER)) AS codigo_ine
  FROM supplier)"""


def at_stations(events: DataFrame) -> DataFrame:
    """Events of the stations: three users share two of them, as many as there are suppliers."""
    return events.withColumn("user_id", F.floor(F.col("user_id") * 2 / 3))


AT_STATIONS = "at_stations AS (SELECT * REPLACE (CAST(floor(user_id * 2 / 3) AS BIGINT) AS user_id) FROM events)"


def forecast(spark: SparkSession, d: str) -> DataFrame:
    """Daily weather with repeated days: one row per order, the customer being the municipality."""
    price = F.col("o_totalprice")
    key = F.col("o_custkey")
    return load(spark, d, "orders").select(
        ine_code(F.floor(key / 1000), key % 1000).alias("codigo_ine"),
        F.to_date("o_orderdate").alias("fecha_prevision"),
        "o_orderkey", "o_orderstatus",
        (price / 10007).alias("tmax"),
        F.when(F.col("o_orderstatus") != "P", price / 23000).alias("tmin"),
        F.when(F.col("o_orderpriority") != "5-LOW", price / 70919).alias("precipitacion_mm"),
        (price / 53000).alias("et0_evapotranspiracion"),
        (price / 17000).alias("radiacion_solar"),
        (key % 100).cast("int").alias("weather_code"),
        (key % 50 + 50).cast("double").alias("humedad_max"),
        F.when(F.col("o_orderpriority") != "1-URGENT", (key % 50).cast("double")).alias("humedad_min"),
        (F.col("o_orderkey") % 101).cast("double").alias("prob_precipitacion"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Soleado"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("")).alias("estado_cielo_desc"),
    )


FORECAST = """forecast AS (
  SELECT format('{:02d}{:03d}', CAST(o_custkey // 1000 AS INTEGER), CAST(o_custkey % 1000 AS INTEGER)) AS codigo_ine,
         CAST(o_orderdate AS DATE) AS fecha_prevision, o_orderkey, o_orderstatus,
         o_totalprice / 10007 AS tmax,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 23000 END AS tmin,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice / 70919 END AS precipitacion_mm,
         o_totalprice / 53000 AS et0_evapotranspiracion, o_totalprice / 17000 AS radiacion_solar,
         CAST(o_custkey % 100 AS INTEGER) AS weather_code,
         CAST(o_custkey % 50 + 50 AS DOUBLE) AS humedad_max,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_custkey % 50 AS DOUBLE) END AS humedad_min,
         CAST(o_orderkey % 101 AS DOUBLE) AS prob_precipitacion,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'Soleado' WHEN o_orderpriority = '2-HIGH' THEN '' END AS estado_cielo_desc
  FROM orders)"""

SKY_CASE = "CASE weather_code " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in SKY_BY_WEATHER_CODE.items()) + " END"

# The weather of every municipality on the day asked for, and the parcels with it.
LATEST_WEATHER = FORECAST + f""", latest AS (
  SELECT * FROM forecast WHERE fecha_prevision <= DATE '{DAY_AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY codigo_ine ORDER BY fecha_prevision DESC, o_orderkey DESC) = 1),
parcel_weather AS (
  SELECT p.*, (tmax + tmin) / 2 AS temperatura, (humedad_max + humedad_min) / 2 AS humedad_ambiental,
         precipitacion_mm, et0_evapotranspiracion AS et0, radiacion_solar,
         coalesce(nullif(estado_cielo_desc, ''), {SKY_CASE}) AS estado_cielo
  FROM parcels p LEFT JOIN latest USING (codigo_ine))"""


def field_table(spark: SparkSession, d: str) -> DataFrame:
    """The field readings table: one metric per row."""
    v = F.col("value") / 3.71828

    def of(kind: str) -> Column:
        return F.when(F.col("event_type") == kind, v)

    return load(spark, d, "events").select(
        F.col("user_id").cast("string").alias("parcel_id"),
        F.col("ts").alias("timestamp"), F.col("event_id").alias("message_id"),
        of("view").alias("temperatura"), of("click").alias("humedad_ambiental"), of("purchase").alias("humedad_suelo"),
        of("purchase").alias("precipitacion_mm"), of("click").alias("et0"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("cultivo"), (k() % 5).cast("string"))).alias("tipo_cultivo"),
    )


FIELD_TABLE = f"""field_table AS (
  SELECT CAST(user_id AS VARCHAR) AS parcel_id, ts AS "timestamp", event_id AS message_id,
         CASE WHEN event_type = 'view' THEN value / 3.71828 END AS temperatura,
         CASE WHEN event_type = 'click' THEN value / 3.71828 END AS humedad_ambiental,
         CASE WHEN event_type = 'purchase' THEN value / 3.71828 END AS humedad_suelo,
         CASE WHEN event_type = 'purchase' THEN value / 3.71828 END AS precipitacion_mm,
         CASE WHEN event_type = 'click' THEN value / 3.71828 END AS et0,
         CASE WHEN event_type = 'signup' THEN 'cultivo' || ({K_SQL} % 5) END AS tipo_cultivo
  FROM events)"""


def actions(spark: SparkSession, d: str) -> DataFrame:
    """Farmer actions: the signups."""
    kind = F.get(F.array(*[F.lit(x) for x in ("riego", "abonado", "poda", "siega")]), k() % 4)
    return load(spark, d, "events").filter(F.col("event_type") == "signup").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.lit("parcela").alias("entity_type"),
        F.col("user_id").cast("string").alias("entity_id"),
        F.col("ts").alias("timestamp"),
        kind.alias("tipo_evento"),
        F.when(k() % 3 != 0, F.concat(F.lit("abono "), k().cast("string"))).alias("valor"),
        F.col("event_id").alias("message_id"),
    )


ACTIONS = f"""actions AS (
  SELECT 'u' || user_id AS user_id, 'parcela' AS entity_type, CAST(user_id AS VARCHAR) AS entity_id,
         ts AS "timestamp", ['riego', 'abonado', 'poda', 'siega'][{K_SQL} % 4 + 1] AS tipo_evento,
         CASE WHEN {K_SQL} % 3 <> 0 THEN 'abono ' || {K_SQL} END AS valor, event_id AS message_id
  FROM events WHERE event_type = 'signup')"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(*[half_up(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
