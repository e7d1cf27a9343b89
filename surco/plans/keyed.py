"""Queries over keyed tables: upserts, deletes, latest values, actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ine_code
from ..functions.fixed_values import METRICS
from ..operators import actions as act, nesting, proximity, tables as tb, weather
from ..sources.tables import load
from ..streaming.run import located
from ..operators.readings import plants_with_owner
from . import roles
from .forecasts import CENTROIDS, wide_parcels
from .geo import GEODESIC_ALERTS, alerts_of
from .registry import query
from .roles import AS_OF, rounded


@query(f"""
WITH {CENTROIDS}, wanted AS (
  SELECT format('{{:02d}}{{:03d}}', provincia, municipio) AS codigo_ine, CAST(provincia AS VARCHAR) AS provincia,
         lat, lon FROM centros),
existing AS (
  SELECT format('{{:02d}}{{:03d}}', s_nationkey, CAST(s_suppkey % 50 AS INTEGER)) AS codigo_ine,
         arg_max(s_name, s_suppkey) AS nombre, arg_max(CAST(s_nationkey AS VARCHAR), s_suppkey) AS provincia,
         arg_max(s_acctbal / 700, s_suppkey) AS lat, arg_max(s_acctbal / 900, s_suppkey) AS lon
  FROM supplier GROUP BY 1)
SELECT codigo_ine, round(CASE WHEN w.codigo_ine IS NOT NULL THEN w.lat ELSE e.lat END, 6) AS lat,
       round(CASE WHEN w.codigo_ine IS NOT NULL THEN w.lon ELSE e.lon END, 6) AS lon,
       coalesce(e.nombre, 'Municipio ' || codigo_ine) AS nombre, coalesce(e.provincia, w.provincia) AS provincia,
       w.codigo_ine IS NOT NULL AS activo
FROM existing e FULL OUTER JOIN wanted w USING (codigo_ine)
""")
def municipality_sync(spark: SparkSession, d: str) -> DataFrame:
    current = municipalities(spark, d)
    wanted = weather.wanted_municipalities(wide_parcels(spark, d))
    return rounded(tb.sync_dimension(current, wanted, "codigo_ine", ["lat", "lon"], ["nombre", "provincia"]))


def municipalities(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "supplier").select(
        ine_code("s_nationkey", F.col("s_suppkey") % 50).alias("codigo_ine"), "s_suppkey",
        F.col("s_name").alias("nombre"), F.col("s_nationkey").cast("string").alias("provincia"),
        (F.col("s_acctbal") / 700).alias("lat"), (F.col("s_acctbal") / 900).alias("lon"),
    )
    return tb.keep_last(rows, ["codigo_ine"], ["s_suppkey"]).drop("s_suppkey")


@query(f"""
WITH {CENTROIDS}
SELECT DISTINCT format('{{:02d}}{{:03d}}', s_nationkey, CAST(s_suppkey % 50 AS INTEGER)) AS codigo_ine FROM supplier
WHERE format('{{:02d}}{{:03d}}', s_nationkey, CAST(s_suppkey % 50 AS INTEGER)) NOT IN
  (SELECT format('{{:02d}}{{:03d}}', provincia, municipio) FROM centros)
""")
def municipalities_gone(spark: SparkSession, d: str) -> DataFrame:
    wanted = weather.wanted_municipalities(wide_parcels(spark, d))
    return tb.missing_from(municipalities(spark, d), wanted, "codigo_ine").select("codigo_ine")


@query(f"""
WITH {roles.FORECAST}
SELECT codigo_ine, fecha_prevision, round(tmax, 6) AS tmax, round(tmin, 6) AS tmin,
       round(precipitacion_mm, 6) AS precipitacion_mm, estado_cielo_desc FROM forecast
QUALIFY row_number() OVER (PARTITION BY codigo_ine, fecha_prevision
                           ORDER BY (o_orderstatus = 'P')::INT DESC, o_orderkey DESC) = 1
""")
def forecast_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Pending orders are today's run, the others the stored table."""
    rows = roles.forecast(spark, d)
    keys, values = ["codigo_ine", "fecha_prevision"], ["tmax", "tmin", "precipitacion_mm", "estado_cielo_desc"]
    stored = tb.keep_last(rows.filter(F.col("o_orderstatus") != "P"), keys, ["o_orderkey"])
    new = rows.filter(F.col("o_orderstatus") == "P")
    return rounded(tb.merge_latest(stored, new, keys, values, ["o_orderkey"]))


@query("""
SELECT CAST(l_partkey AS VARCHAR) AS sensor_id,
       arg_max(l_suppkey, row(l_shipdate, l_extendedprice, l_orderkey, l_suppkey)) AS connection_id,
       arg_max(l_returnflag, row(l_shipdate, l_extendedprice, l_orderkey, l_suppkey)) AS sensor_type,
       arg_min(l_linestatus, row(l_shipdate, l_extendedprice, l_orderkey, l_suppkey)) AS user_id
FROM lineitem GROUP BY 1
""")
def sensor_registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The owner of a sensor stays the first one, the rest follows the last change."""
    rows = load(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("sensor_id"), F.col("l_suppkey").alias("connection_id"),
        F.col("l_returnflag").alias("sensor_type"), F.col("l_linestatus").alias("user_id"),
        "l_shipdate", "l_extendedprice", "l_orderkey", "l_suppkey",
    )
    order = ["l_shipdate", "l_extendedprice", "l_orderkey", "l_suppkey"]
    return tb.merge_latest(None, rows, ["sensor_id"], ["connection_id", "sensor_type"], order, ["user_id"])


@query("""
WITH stored AS (SELECT s_nationkey AS usuario_id, CASE WHEN s_acctbal > 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS parcela_id
                FROM supplier)
SELECT c_custkey AS id, c_nationkey AS usuario_id, c_mktsegment AS parcela_id,
       c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment)
       AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.usuario_id = c_nationkey AND s.parcela_id = c_mktsegment) AS aceptada
FROM customer
""")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    stored = load(spark, d, "supplier").select(
        F.col("s_nationkey").alias("usuario_id"),
        F.when(F.col("s_acctbal") > 0, F.lit("BUILDING")).otherwise(F.lit("MACHINERY")).alias("parcela_id"),
    )
    rows = load(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("usuario_id"), F.col("c_mktsegment").alias("parcela_id")
    )
    return tb.mark_insertable(stored, rows, ["usuario_id", "parcela_id"], ["id"], "aceptada")


@query("""
WITH gone AS (
  SELECT c_custkey FROM customer JOIN supplier ON s_suppkey = c_custkey // 15 AND s_nationkey = c_nationkey)
SELECT 'invernadero' AS tabla, c_custkey AS id, c_nationkey AS dueno FROM customer WHERE c_custkey NOT IN (SELECT * FROM gone)
UNION ALL
SELECT 'planta', o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT * FROM gone)
""")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Delete requests name a greenhouse and an owner; wrong owners delete nothing."""
    customers, orders = load(spark, d, "customer"), load(spark, d, "orders")
    asked = customers.select("c_custkey", F.floor(F.col("c_custkey") / 15).alias("s_suppkey")).join(
        load(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey")), "s_suppkey"
    )
    houses, (plants,) = tb.delete_cascade(
        customers, asked, ["c_custkey", "c_nationkey"], [(orders, "o_custkey", "c_custkey")]
    )
    first = houses.select(F.lit("invernadero").alias("tabla"), F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("dueno"))
    return first.unionByName(plants.select(F.lit("planta").alias("tabla"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dueno")))


@query("""
WITH cambios AS (
  SELECT l_orderkey, CASE WHEN max(l_linenumber) > 3 THEN max(l_returnflag) END AS estado FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_custkey, CASE WHEN l_orderkey IS NOT NULL THEN estado ELSE o_orderstatus END AS o_orderstatus
FROM orders LEFT JOIN cambios ON l_orderkey = o_orderkey
""")
def update_by_key(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.when(F.max("l_linenumber") > 3, F.max("l_returnflag")).alias("o_orderstatus")
    )
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return tb.update_by_key(orders, lines, ["o_orderkey"], ["o_orderstatus"])


@query("""
WITH z AS (
  SELECT o_orderkey, list(CAST(l_linenumber AS VARCHAR) ORDER BY l_linenumber) FILTER (WHERE l_orderkey IS NOT NULL) AS ids
  FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1),
a AS (SELECT o_orderkey, list_append(coalesce(ids, []::VARCHAR[]), 'nueva') AS ids FROM z)
SELECT o_orderkey, array_to_string(ids, ',') AS tras_anadir,
       array_to_string([x FOR x IN ids IF x <> '1'], ',') AS tras_quitar FROM a
""")
def array_append_remove(spark: SparkSession, d: str) -> DataFrame:
    """Zones of a field as an array of structs: add one, then drop by id."""
    zone = F.struct(
        F.col("l_linenumber").cast("string").alias("id"), F.lit(39.0).alias("lat"), F.lit(-0.3).alias("lng"),
        F.col("l_returnflag").alias("cultivo"), F.lit("x").alias("emoji"),
    )
    # A field has one zone per line number, so an array stays short.
    lines = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(
        F.max("l_returnflag").alias("l_returnflag")
    )
    zones = lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(zone)).alias("zonas"))
    fields = load(spark, d, "orders").select("o_orderkey").join(zones, "o_orderkey", "left")
    new = F.struct(F.lit("nueva").alias("id"), F.lit(39.1).alias("lat"), F.lit(-0.2).alias("lng"),
                   F.lit("olivo").alias("cultivo"), F.lit("o").alias("emoji"))
    grown = tb.array_append(fields, "zonas", new)
    cut = tb.array_remove(grown.withColumn("antes", F.array_join("zonas.id", ",")), "zonas", F.lit("1"))
    return cut.select("o_orderkey", F.col("antes").alias("tras_anadir"), F.array_join("zonas.id", ",").alias("tras_quitar"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 25 AS usuario_id FROM lineitem
WHERE EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey
              WHERE o_orderkey = l_orderkey AND c_nationkey = l_suppkey % 25)
""")
def ownership_semi(spark: SparkSession, d: str) -> DataFrame:
    """Claims (plant, user) that hold: the user owns the greenhouse of the plant."""
    claims = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 25).alias("usuario_id")
    )
    owners = load(spark, d, "orders").join(
        load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("usuario_id")),
        "o_custkey",
    ).select(F.col("o_orderkey").alias("l_orderkey"), "usuario_id")
    return tb.owned_by(claims, (owners, ["l_orderkey", "usuario_id"]))


@query(f"""
WITH {roles.FIELD_TABLE}
SELECT parcel_id, {", ".join(f'round(arg_max({c}, row("timestamp", message_id)) FILTER (WHERE {c} IS NOT NULL), 6) AS {c}' for c in METRICS)}
FROM field_table GROUP BY 1
""")
def state_latest_by_field(spark: SparkSession, d: str) -> DataFrame:
    """Latest present value of every metric per field."""
    rows = roles.field_table(spark, d)
    state = tb.merge_latest(None, rows, ["parcel_id"], METRICS, ["timestamp", "message_id"], skip_nulls=True)
    return rounded(state)


HOUSE_STATE = roles.HOUSE_READINGS + """, located AS (
  SELECT CAST(c.c_nationkey AS VARCHAR) AS user_id, r.entity_id AS greenhouse_id, CAST(NULL AS VARCHAR) AS plant_id,
         sensor_tipo, valor, event_time, message_id
  FROM house_readings r JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = r.entity_id WHERE entity_type = 'invernadero'
  UNION ALL
  SELECT CAST(c.c_nationkey AS VARCHAR), CAST(o.o_custkey AS VARCHAR), r.entity_id, sensor_tipo, valor, event_time, message_id
  FROM house_readings r JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = r.entity_id
  JOIN customer c ON c.c_custkey = o.o_custkey WHERE entity_type = 'planta'),
house_state AS (
  SELECT * FROM located
  QUALIFY row_number() OVER (PARTITION BY user_id, greenhouse_id, plant_id, sensor_tipo ORDER BY event_time DESC, message_id DESC) = 1)"""


def house_state(spark: SparkSession, d: str) -> DataFrame:
    houses = roles.greenhouses(spark, d)
    members = plants_with_owner(roles.plants(spark, d), houses)
    rows = located(roles.house_readings(spark, d), members, houses)
    keys = ["user_id", "greenhouse_id", "plant_id", "sensor_tipo"]
    return tb.merge_latest(None, rows, keys, ["valor"], ["event_time", "message_id"])


@query(f"""
WITH {HOUSE_STATE}
SELECT user_id, greenhouse_id, plant_id, sensor_tipo, round(valor, 6) AS valor FROM house_state
""")
def greenhouse_state(spark: SparkSession, d: str) -> DataFrame:
    return rounded(house_state(spark, d))


@query(f"""
WITH {HOUSE_STATE}
SELECT user_id, greenhouse_id, plant_id,
       {", ".join(f"round(max(valor) FILTER (WHERE sensor_tipo = '{m}'), 6) AS {m}" for m in METRICS)}
FROM house_state GROUP BY ALL
""")
def greenhouse_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Latest values of every greenhouse and plant, one row each."""
    return rounded(nesting.plant_snapshot(house_state(spark, d)))


@query(f"""
WITH {roles.ACTIONS}, ok AS (SELECT * FROM actions WHERE tipo_evento <> 'siega')
SELECT user_id, entity_id,
       max("timestamp") FILTER (WHERE tipo_evento = 'riego') AS ultimo_riego,
       max("timestamp") FILTER (WHERE tipo_evento = 'abonado') AS ultimo_abonado,
       max("timestamp") FILTER (WHERE tipo_evento = 'poda') AS ultima_poda,
       arg_max(valor, row("timestamp", message_id)) FILTER (WHERE tipo_evento = 'abonado' AND valor <> '') AS tipo_abono
FROM actions GROUP BY ALL
""")
def last_action_state(spark: SparkSession, d: str) -> DataFrame:
    """The log in two calls that cut across its order."""
    rows = roles.actions(spark, d)
    even = F.col("message_id") % 2 == 0
    old = act.last_action_state(None, rows.filter(even))
    return act.last_action_state(old, rows.filter(~even)).drop("abono_orden")


# Day, instant, or neither; some of each unreadable; some without a user.
ACTION_REQUESTS = roles.ACTIONS + f""", requests AS (
  SELECT message_id, CASE WHEN message_id % 11 <> 0 THEN user_id END AS user_id,
         CASE WHEN message_id % 2 = 0 THEN entity_type END AS entity_type, entity_id, tipo_evento, valor,
         CASE WHEN message_id % 3 = 0 THEN CASE WHEN message_id % 7 = 0 THEN 'ayer' ELSE strftime("timestamp", '%Y-%m-%d') END END AS fecha,
         CASE WHEN message_id % 3 = 1 THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || '+02:00' END AS instante,
         "timestamp" AS visto
  FROM actions),
checked AS (
  SELECT *, CASE WHEN message_id % 11 = 0 THEN 'user_id, entity_id and tipo_evento are required'
                 WHEN tipo_evento = 'siega' THEN 'unknown tipo_evento' WHEN fecha = 'ayer' THEN 'unreadable date' END AS reason
  FROM requests)"""


def action_requests(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("message_id")
    rows = roles.actions(spark, d)
    day = F.when(m % 7 == 0, F.lit("ayer")).otherwise(F.date_format("timestamp", "yyyy-MM-dd"))
    instant = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return rows.select(
        "message_id",
        F.when(m % 11 != 0, F.col("user_id")).alias("user_id"),
        F.when(m % 2 == 0, F.col("entity_type")).alias("entity_type"),
        "entity_id", "tipo_evento", "valor",
        F.when(m % 3 == 0, day).alias("fecha"), F.when(m % 3 == 1, instant).alias("timestamp"),
    )


@query(f"""
WITH {ACTION_REQUESTS}
SELECT message_id, user_id, coalesce(entity_type, 'parcela') AS entity_type, entity_id, tipo_evento, valor,
       CASE WHEN fecha IS NOT NULL THEN CAST(fecha AS DATE) + INTERVAL 12 HOUR
            WHEN instante IS NOT NULL THEN date_trunc('second', visto) ELSE TIMESTAMP '{AS_OF}' END AS "timestamp"
FROM checked WHERE reason IS NULL
""")
def action_validation(spark: SparkSession, d: str) -> DataFrame:
    valid, _ = act.validate_actions(action_requests(spark, d), AS_OF)
    return valid


@query(f"""
WITH {ACTION_REQUESTS} SELECT message_id, reason FROM checked WHERE reason IS NOT NULL
""")
def action_rejects(spark: SparkSession, d: str) -> DataFrame:
    _, bad = act.validate_actions(action_requests(spark, d), AS_OF)
    return bad.select("message_id", "reason")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'o_orderstatus' || CASE WHEN o_orderpriority IN ('5-LOW') THEN ', o_orderpriority' ELSE '' END
       WHEN o_orderpriority = '5-LOW' THEN 'o_orderpriority' ELSE '' END AS reason FROM orders
""")
def allowed_values(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    ok, bad = tb.check_allowed(rows, {
        "o_orderstatus": ["F", "O"],
        "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"],
    })
    return ok.withColumn("reason", F.lit("")).unionByName(bad).select("o_orderkey", "reason")


@query("""
SELECT c_custkey AS sensor_id, c_nationkey AS location_id, 'parcela' AS location_type,
       CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'sin' END AS tipo FROM customer
""")
def schema_migration(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer").select(
        F.col("c_custkey").alias("sensor_id"), F.col("c_nationkey").alias("parcela_usuario_id"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("tipo"),
    )
    moved, _ = tb.migrate(
        rows, renames={"parcela_usuario_id": "location_id"}, adds={"location_type": "string"},
        fills={"location_type": "parcela", "tipo": "sin"},
        checks={"location_type": ["parcela", "invernadero", "planta"]},
    )
    return moved


@query("""
SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey DESC
""")
def owner_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return tb.listing(rows, {"c_mktsegment": "BUILDING"}, [F.col("c_custkey").desc()])


@query(f"""
{GEODESIC_ALERTS}, keyed AS (
  SELECT *, CASE WHEN alerta = 'place' THEN id_place ELSE id_victima END || '_' || id_agresor AS doc_id FROM alerts)
SELECT doc_id, max("timestamp") AS "timestamp",
       arg_max(distancia_metros, row("timestamp", id_victima, coalesce(coordenadas_victima, ''), distancia_metros)) AS distancia_metros
FROM keyed GROUP BY 1
""")
def alert_documents(spark: SparkSession, d: str) -> DataFrame:
    """Latest alert per pair."""
    alerts = alerts_of(spark, d, "geodesic").withColumn("_v", F.coalesce("coordenadas_victima", F.lit("")))
    order = ["timestamp", "id_victima", "_v", "distancia_metros"]
    state = tb.merge_latest(None, alerts.withColumn("doc_id", proximity.alert_key()), ["doc_id"],
                            ["timestamp", "distancia_metros"], order, skip_nulls=True)
    return rounded(state)
