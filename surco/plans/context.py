"""Queries that answer questions for every field at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context as cx
from ..operators.tables import latest_non_null
from ..sources.tables import load
from . import roles
from .registry import query
from .roles import AS_OF, rounded


def _recent(hours: int) -> str:
    return f"""\"timestamp\" >= TIMESTAMP '{AS_OF}' - INTERVAL {hours} HOUR"""


@query(f"""
WITH {roles.FIELD_TABLE}, s AS (
  SELECT parcel_id, avg(temperatura) AS t, avg(humedad_suelo) AS s, avg(humedad_ambiental) AS h
  FROM field_table WHERE {_recent(24)} GROUP BY 1)
SELECT parcel_id, round(t, 2) AS temperatura_media, CASE WHEN t IS NOT NULL THEN round(s, 2) END AS humedad_suelo_media,
       CASE WHEN t IS NOT NULL THEN round(h, 2) END AS humedad_ambiental_media FROM s
""")
def stats_24h(spark: SparkSession, d: str) -> DataFrame:
    return cx.stats_24h(roles.field_table(spark, d), AS_OF)


@query(f"""
WITH {roles.FIELD_TABLE}, s AS (
  SELECT parcel_id, avg(temperatura) AS t, sum(precipitacion_mm) AS p, sum(et0) AS e
  FROM field_table WHERE {_recent(168)} GROUP BY 1)
SELECT parcel_id, round(t, 2) AS temperatura_media, CASE WHEN t IS NOT NULL THEN round(p, 2) END AS precipitacion_mm_acumulado,
       CASE WHEN t IS NOT NULL THEN round(e, 2) END AS et0_acumulado FROM s
""")
def stats_7d(spark: SparkSession, d: str) -> DataFrame:
    return cx.stats_7d(roles.field_table(spark, d), AS_OF)


@query(f"""
WITH {roles.FIELD_TABLE}, dias AS (
  SELECT parcel_id, CAST("timestamp" AS DATE) AS dia, sum(temperatura) AS ts, count(temperatura) AS tn,
         max(precipitacion_mm) AS p, max(et0) AS e FROM field_table WHERE {_recent(168)} GROUP BY ALL),
s AS (SELECT parcel_id, sum(ts) / nullif(sum(tn), 0) AS t, sum(p) AS p, sum(e) AS e FROM dias GROUP BY 1)
SELECT parcel_id, round(t, 2) AS temperatura_media, CASE WHEN t IS NOT NULL THEN round(p, 2) END AS precipitacion_mm_acumulado,
       CASE WHEN t IS NOT NULL THEN round(e, 2) END AS et0_acumulado FROM s
""")
def stats_7d_daily(spark: SparkSession, d: str) -> DataFrame:
    return cx.stats_7d(roles.field_table(spark, d), AS_OF, mode="daily")


@query(f"""
WITH {roles.ACTIONS}
SELECT entity_id AS parcel_id, tipo_evento AS tipo, "timestamp" AS fecha, valor AS detalle, message_id,
       CAST(row_number() OVER (PARTITION BY entity_id ORDER BY "timestamp" DESC, message_id DESC) AS INTEGER) AS puesto
FROM actions QUALIFY puesto <= 5
""")
def last_actions_top5(spark: SparkSession, d: str) -> DataFrame:
    return cx.last_actions(roles.actions(spark, d), 5, ["message_id"])


@query("""
SELECT o_custkey AS parcel_id, arg_max(o_orderpriority, row(o_orderdate, o_orderkey)) AS tipo_cultivo FROM orders
WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY 1
""")
def latest_non_null_crop(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select(
        F.col("o_custkey").alias("parcel_id"), "o_orderdate", "o_orderkey",
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("tipo_cultivo"),
    )
    return latest_non_null(rows, ["parcel_id"], "tipo_cultivo", ["o_orderdate", "o_orderkey"])


@query(f"""
WITH {roles.FIELD_TABLE}, {roles.ACTIONS}, s AS (
  SELECT parcel_id, arg_max(tipo_cultivo, "timestamp") FILTER (WHERE tipo_cultivo IS NOT NULL) AS cultivo,
         avg(temperatura) FILTER (WHERE {_recent(24)}) AS dt, avg(humedad_suelo) FILTER (WHERE {_recent(24)}) AS ds,
         avg(humedad_ambiental) FILTER (WHERE {_recent(24)}) AS dh, avg(temperatura) FILTER (WHERE {_recent(168)}) AS wt,
         sum(precipitacion_mm) FILTER (WHERE {_recent(168)}) AS wp, sum(et0) FILTER (WHERE {_recent(168)}) AS we
  FROM field_table GROUP BY 1),
a AS (
  SELECT entity_id, string_agg(tipo_evento || '@' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || coalesce('=' || valor, ''), '; '
                               ORDER BY "timestamp" DESC, message_id DESC) AS acciones
  FROM (SELECT * FROM actions QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY "timestamp" DESC, message_id DESC) <= 5)
  GROUP BY 1)
SELECT parcel_id, cultivo, round(dt, 2) AS temp_24h, CASE WHEN dt IS NOT NULL THEN round(ds, 2) END AS suelo_24h,
       CASE WHEN dt IS NOT NULL THEN round(dh, 2) END AS ambiente_24h, round(wt, 2) AS temp_7d,
       CASE WHEN wt IS NOT NULL THEN round(wp, 2) END AS lluvia_7d, CASE WHEN wt IS NOT NULL THEN round(we, 2) END AS et0_7d,
       coalesce(acciones, '') AS acciones
FROM s LEFT JOIN a ON entity_id = parcel_id
""")
def entity_context(spark: SparkSession, d: str) -> DataFrame:
    """The nested record per field, flattened for comparison."""
    nested = cx.entity_context(roles.field_table(spark, d), roles.actions(spark, d), AS_OF, 5, ["message_id"])
    line = F.transform("acciones_recientes", lambda a: F.concat(
        a["tipo"], F.lit("@"), F.date_format(a["fecha"], "yyyy-MM-dd'T'HH:mm:ss"),
        F.coalesce(F.concat(F.lit("="), a["detalle"]), F.lit("")),
    ))
    return nested.select(
        "parcel_id", "cultivo",
        F.col("ultimas_24h.temp_media").alias("temp_24h"),
        F.col("ultimas_24h.humedad_suelo_media").alias("suelo_24h"),
        F.col("ultimas_24h.humedad_ambiental_media").alias("ambiente_24h"),
        F.col("ultimos_7d.temp_media").alias("temp_7d"),
        F.col("ultimos_7d.precipitacion_acumulada").alias("lluvia_7d"),
        F.col("ultimos_7d.et0_acumulado").alias("et0_7d"),
        F.array_join(line, "; ").alias("acciones"),
    )


@query(f"""
WITH {roles.FIELD_TABLE}
SELECT min(CAST("timestamp" AS DATE)) AS desde, max(CAST("timestamp" AS DATE)) AS hasta, count(*) AS filas,
       count(DISTINCT parcel_id) AS parcelas,
       count(*) - count(temperatura) AS nulos_temperatura, round(avg(temperatura), 6) AS media_temperatura,
       round(stddev_samp(temperatura), 6) AS desv_temperatura, count(*) - count(et0) AS nulos_et0,
       round(avg(et0), 6) AS media_et0, round(stddev_samp(et0), 6) AS desv_et0,
       count(*) FILTER (WHERE tipo_cultivo = 'cultivo1') AS dias_forecast
FROM field_table
""")
def dataset_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = roles.field_table(spark, d).withColumn("dia", F.to_date("timestamp"))
    return rounded(cx.profile(rows, "parcel_id", "dia", ["temperatura", "et0"], "tipo_cultivo", "cultivo1"))


@query("SELECT o_orderpriority, count(*) AS filas FROM orders GROUP BY 1")
def rows_by_source(spark: SparkSession, d: str) -> DataFrame:
    return cx.rows_by_source(load(spark, d, "orders"), "o_orderpriority")


@query("""
SELECT c_custkey AS entity_id, unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', INTERVAL 1 HOUR)) AS ts
FROM customer
""")
def time_spine(spark: SparkSession, d: str) -> DataFrame:
    entities = load(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"))
    return cx.time_spine(entities, "2024-01-01", 48)


@query("""
WITH espina AS (
  SELECT c_custkey AS entity_id, unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 6 HOUR)) AS ts FROM customer)
SELECT e.entity_id, e.ts, round(least(88, greatest(15, 12 + coalesce(sum(value / 3.71828 *
         exp(-0.2 * (epoch_us(e.ts) - epoch_us(v.ts)) / 86400000000.0)), 0))), 6) AS humedad
FROM espina e LEFT JOIN events v ON v.user_id = e.entity_id AND v.event_type = 'signup' AND v.ts <= e.ts
GROUP BY ALL
""")
def decayed_response(spark: SparkSession, d: str) -> DataFrame:
    """Soil moisture of every field as the fading sum of its past waterings."""
    entities = load(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"))
    hits = load(spark, d, "events").filter(F.col("event_type") == "signup").select(
        F.col("user_id").alias("entity_id"), "ts", (F.col("value") / 3.71828).alias("amp")
    )
    out = cx.decayed_response(
        entities, hits, "entity_id", "ts", "amp", 0.2, "2024-01-01", 120, "6 hours", base=12.0, low=15.0, high=88.0,
        into="humedad",
    )
    return rounded(out)
