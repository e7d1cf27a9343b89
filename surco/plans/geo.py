"""Queries over positions and polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import lat_lon_text
from ..functions.fixed_values import COMPASS, EARTH_RADIUS_M, MERCATOR_HALF_M, WGS84_A, WGS84_F
from ..functions.geodesy import compass_sector, from_mercator, tile_key, to_mercator
from ..operators import geometry as gm, nesting
from ..operators.proximity import proximity_alerts as find_alerts
from ..operators.tables import keep_last
from ..sources.messages import with_lat_lon
from ..sources.tables import load, safe_zones
from . import roles
from .registry import query
from .roles import K_SQL, rounded

EVERY = "1 hour"
HALF = f"{MERCATOR_HALF_M!r}"


def sector_sql(dlat: str, dlon: str) -> str:
    angle = f"degrees(atan2({dlat}, {dlon}))"
    turned = f"(CASE WHEN {angle} < 0 THEN {angle} + 360 ELSE {angle} END)"
    steps = " ".join(f"WHEN {turned} < {22.5 + 45 * i} THEN '{COMPASS[i]}'" for i in range(8))
    return f"CASE {steps} ELSE '{COMPASS[0]}' END"


@query(f"""
SELECT event_id, {sector_sql(f'(value - 60)', f'({K_SQL} - 50)')} AS sector FROM events
""")
def bearing_sector(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(
        "event_id", compass_sector(F.col("value") - 60, (roles.k() - 50).cast("double")).alias("sector")
    )


# ---- proximity ------------------------------------------------------------

def positions(spark: SparkSession, d: str) -> DataFrame:
    return positions_of(load(spark, d, "events"))


def positions_of(events: DataFrame) -> DataFrame:
    """Views and clicks are victims, the others aggressors; clicks write coordinates as a list."""
    lat = (F.col("value") / 10000 + 39).cast("decimal(9,6)").cast("string")
    lon = (roles.k() / 10000 - 0.3).cast("decimal(9,6)").cast("string")
    text = F.when(F.col("event_type") == "click", F.concat(F.lit("["), lat, F.lit(","), lon, F.lit("]"))).otherwise(
        F.concat(lat, F.lit(","), lon)
    )
    rows = events.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("event_type").isin("view", "click"), F.lit("victima")).otherwise(F.lit("agresor")).alias("tipo"),
        lat_lon_text(text).alias("coordinates"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("ts").alias("event_time"), F.col("event_id").alias("message_id"),
    )
    return with_lat_lon(rows)


def links_seen(spark: SparkSession, d: str) -> DataFrame:
    """Every order links its customer to an aggressor, any of the users; a pair may be there more than once."""
    users = load(spark, d, "events").agg(F.max("user_id") + 1).scalar()
    return load(spark, d, "orders").select(
        F.col("o_custkey").alias("id_victima"), F.pmod(F.col("o_orderkey"), users).alias("id_agresor"), "o_orderkey",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") / 130).alias("dist_seguridad"),
    )


def relations(spark: SparkSession, d: str) -> DataFrame:
    return keep_last(links_seen(spark, d), ["id_victima", "id_agresor"], ["o_orderkey"]).drop("o_orderkey")


def zones(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers are places, each customer has the one with its own number, counted round."""
    lat = (F.col("s_acctbal") / 400000 + 39).cast("decimal(9,6)").cast("string")
    lon = (F.col("s_suppkey") / 10000 - 0.3).cast("decimal(9,6)").cast("string")
    places = load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id_place"), F.col("s_name").alias("place_name"),
        F.concat(lat, F.lit(","), lon).alias("place_coordinates"), (F.col("s_nationkey") * 10 + 50).alias("radius"),
    )
    every = load(spark, d, "supplier").agg(F.max("s_suppkey") + 1).scalar()
    links = load(spark, d, "customer").select(F.pmod(F.col("c_custkey"), every).alias("id_place"), F.col("c_custkey").alias("id_victima"))
    return safe_zones(places, links)


AGGRESSOR_SQL = "o_orderkey % (SELECT max(user_id) + 1 FROM events)"

MET = f"""WITH pos AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, event_type IN ('view', 'click') AS victim, date_trunc('hour', ts) AS w,
         CAST(value / 10000 + 39 AS DECIMAL(9,6)) AS lat, CAST({K_SQL} / 10000 - 0.3 AS DECIMAL(9,6)) AS lon,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", ts, event_id FROM events),
agr AS (
  SELECT * FROM pos WHERE NOT victim QUALIFY row_number() OVER (PARTITION BY user_id, w ORDER BY ts DESC, event_id DESC) = 1),
rel AS (
  SELECT CAST(o_custkey AS VARCHAR) AS v, CAST({AGGRESSOR_SQL} AS VARCHAR) AS a,
         coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice / 130 END, 500) AS dist FROM orders
  QUALIFY row_number() OVER (PARTITION BY v, a ORDER BY o_orderkey DESC) = 1),
zones AS (
  SELECT CAST(c_custkey AS VARCHAR) AS v, CAST(s_suppkey AS VARCHAR) AS id_place, s_name AS nombre_place,
         CAST(s_acctbal / 400000 + 39 AS DECIMAL(9,6)) AS zlat, CAST(s_suppkey / 10000 - 0.3 AS DECIMAL(9,6)) AS zlon,
         CAST(s_nationkey * 10 + 50 AS DOUBLE) AS radius
  FROM supplier JOIN customer ON c_custkey % (SELECT max(s_suppkey) + 1 FROM supplier) = s_suppkey),
met AS (
  SELECT p.user_id AS id_victima, rel.a AS id_agresor, rel.dist, p.lat AS vlat, p.lon AS vlon, agr.lat AS alat,
         agr.lon AS alon, agr."timestamp"
  FROM pos p JOIN rel ON rel.v = p.user_id JOIN agr ON agr.user_id = rel.a AND agr.w = p.w WHERE p.victim),
cases AS (
  SELECT 'fisica' AS alerta, *, NULL AS id_place, NULL AS nombre_place, CAST(NULL AS DOUBLE) AS radius,
         CAST(vlat AS DOUBLE) AS blat, CAST(vlon AS DOUBLE) AS blon,
         CAST(alat AS DOUBLE) AS lat0, CAST(alon AS DOUBLE) AS lon0 FROM met
  UNION ALL
  SELECT 'place', met.*, id_place, nombre_place, radius, CAST(zlat AS DOUBLE), CAST(zlon AS DOUBLE),
         CAST(alat AS DOUBLE), CAST(alon AS DOUBLE)
  FROM met JOIN zones ON zones.v = met.id_victima)"""

ALERT_ROWS = f""", alerts AS (
  SELECT alerta, true AS activa, id_victima, id_agresor, round(m, 2) AS distancia_metros,
         {sector_sql('(lat0 - blat)', '(lon0 - blon)')} AS direccion_escape, alat || ',' || alon AS coordenadas_agresor,
         CASE WHEN alerta = 'fisica' THEN vlat || ',' || vlon END AS coordenadas_victima,
         CASE WHEN alerta = 'place' THEN CAST(blat AS DECIMAL(9,6)) || ',' || CAST(blon AS DECIMAL(9,6)) END AS coordenadas_place,
         "timestamp", dist AS dist_seguridad, id_place, nombre_place, radius AS radio_zona,
         CAST(NULL AS VARCHAR) AS nivel, CAST(NULL AS DOUBLE) AS distancia_limite
  FROM measured WHERE CASE WHEN alerta = 'fisica' THEN round(m, 2) < dist ELSE m < dist + radius END)"""

HAVERSINE_ALERTS = MET + f""", measured AS (
  SELECT *, {2 * EARTH_RADIUS_M!r} * asin(sqrt(pow(sin(radians(blat - lat0) / 2), 2)
         + cos(radians(lat0)) * cos(radians(blat)) * pow(sin(radians(blon - lon0) / 2), 2))) AS m FROM cases)""" + ALERT_ROWS


def _vincenty_sql(rounds: int = 8) -> str:
    """Vincenty's inverse formula with its iteration written out, for near points."""
    f, a = repr(WGS84_F), repr(WGS84_A)
    b = repr(WGS84_A * (1 - WGS84_F))
    parts = [f""", v0 AS (
  SELECT *, atan((1 - {f}) * tan(radians(lat0))) AS u1, atan((1 - {f}) * tan(radians(blat))) AS u2,
         radians(blon - lon0) AS span, radians(blon - lon0) AS lam FROM cases)"""]
    for i in range(rounds):
        parts.append(f""", a{i} AS (
  SELECT * , sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
         sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM v{i}),
b{i} AS (SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM a{i}),
c{i} AS (SELECT *, 1 - sa * sa AS c2, cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) AS mid FROM b{i}),
d{i} AS (SELECT *, {f} / 16 * c2 * (4 + {f} * (4 - 3 * c2)) AS cc FROM c{i}),
v{i + 1} AS (SELECT * EXCLUDE (lam, ss, cs, sg, sa, c2, mid, cc), ss AS ss_, cs AS cs_, sg AS sg_, c2 AS c2_, mid AS mid_,
         span + (1 - cc) * {f} * sa * (sg + cc * ss * (mid + cc * cs * (2 * mid * mid - 1))) AS lam
  FROM (SELECT * EXCLUDE ({'ss_, cs_, sg_, c2_, mid_' if i else 'zz'}) FROM (SELECT *{'' if i else ', 0 AS zz'} FROM d{i})))""")
    parts.append(f""", last AS (
  SELECT *, c2_ * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS k FROM v{rounds}),
coef AS (
  SELECT *, 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))) AS ba,
         k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) AS bb FROM last),
measured AS (
  SELECT *, {b} * ba * (sg_ - bb * ss_ * (mid_ + bb / 4 * (cs_ * (2 * mid_ * mid_ - 1)
         - bb / 6 * mid_ * (4 * ss_ * ss_ - 3) * (4 * mid_ * mid_ - 3)))) AS m FROM coef)""")
    return "".join(parts)


GEODESIC_ALERTS = MET + _vincenty_sql() + ALERT_ROWS

ALERT_COLUMNS = (
    "alerta", "activa", "nivel", "id_victima", "id_agresor", "distancia_metros", "direccion_escape",
    "coordenadas_agresor", "coordenadas_victima", "coordenadas_place", "timestamp", "dist_seguridad",
    "distancia_limite", "id_place", "nombre_place", "radio_zona",
)
ALERT_SELECT = "SELECT * REPLACE (round(dist_seguridad, 6) AS dist_seguridad) FROM alerts"


def alerts_of(spark: SparkSession, d: str, metric: str) -> DataFrame:
    return find_alerts(positions(spark, d), relations(spark, d), zones(spark, d), EVERY, metric).select(*ALERT_COLUMNS)


@query(HAVERSINE_ALERTS + ALERT_SELECT)
def proximity_alerts_sphere(spark: SparkSession, d: str) -> DataFrame:
    return rounded(alerts_of(spark, d, "haversine"))


@query(GEODESIC_ALERTS + ALERT_SELECT)
def proximity_alerts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(alerts_of(spark, d, "geodesic"))


@query(f"""
{MET}, raw AS (
  SELECT CAST(o_custkey AS VARCHAR) AS v, CAST({AGGRESSOR_SQL} AS VARCHAR) AS a,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice / 130 END AS dist FROM orders
  QUALIFY row_number() OVER (PARTITION BY v, a ORDER BY o_orderkey DESC) = 1)
SELECT v AS id_victima, 'agresor' AS clase, a AS id_miembro, round(dist, 6) AS dist_seguridad, NULL AS place_name, CAST(NULL AS DOUBLE) AS radius FROM raw
UNION ALL
SELECT v, 'zona', id_place, NULL, nombre_place, radius FROM zones
""")
def victim_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations and zones of every victim, one row each."""
    rel = links_seen(spark, d)
    rel = rel.select(*[F.col(c).cast("string").alias(c) for c in ("id_victima", "id_agresor")], "dist_seguridad", "o_orderkey")
    out = nesting.relations_by_victim(rel, zones(spark, d), ["o_orderkey"])
    return rounded(out.select("id_victima", "clase", "id_miembro", "dist_seguridad", "place_name", F.col("radius").cast("double").alias("radius")))


# ---- projection and parcels -----------------------------------------------

LAT, LNG = "(c_acctbal / 137 - 5)", "(c_custkey % 350 - 174.3 + c_acctbal / 21000)"


@query(f"""
WITH p AS (SELECT c_custkey, {LAT} AS lat, {LNG} AS lng FROM customer),
m AS (SELECT *, lng * {HALF} / 180 AS x, ln(tan((90 + lat) * pi() / 360)) / (pi() / 180) * {HALF} / 180 AS y FROM p)
SELECT c_custkey, round(x, 3) AS x, round(y, 3) AS y, CAST(floor((lng + 180) / 360 * 32768) AS BIGINT) AS tx,
       32767 - CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 32768) AS BIGINT) AS ty,
       round(lat, 6) AS lat, round(lng, 6) AS lng
FROM m
""")
def mercator_tile(spark: SparkSession, d: str) -> DataFrame:
    """Projection, tile and the way back."""
    points = load(spark, d, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 137 - 5).alias("lat0"),
        (F.col("c_custkey") % 350 - 174.3 + F.col("c_acctbal") / 21000).alias("lng0"),
    )
    x, y = to_mercator("lat0", "lng0")
    tx, ty = tile_key("lat0", "lng0", 15)
    lat, lng = from_mercator(F.col("x_"), F.col("y_"))
    out = points.withColumn("x_", x).withColumn("y_", y)
    return out.select(
        "c_custkey", F.round("x_", 3).alias("x"), F.round("y_", 3).alias("y"),
        tx.cast("bigint").alias("tx"), ty.cast("bigint").alias("ty"),
        F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng"),
    )


# Fixed shapes in metres from the corner of a supplier's cell: an L, and a small square.
SHAPE = ((0, 0), (300, 0), (300, 100), (120, 100), (120, 300), (0, 300), (0, 0))
SECOND = ((310, 310), (390, 310), (390, 390), (310, 390), (310, 310))
CELL, ROW = 400, 1000
X0, Y0 = -500000.5, 4500000.25


def polygons(spark: SparkSession, d: str) -> DataFrame:
    """One parcel per supplier; every odd one has a second part."""
    cx = (F.col("s_suppkey") % ROW) * CELL + X0
    cy = F.floor(F.col("s_suppkey") / ROW) * CELL + Y0

    def ring(shape):
        return F.array(*[F.array(cx + x, cy + y) for x, y in shape])

    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring(SHAPE)).alias("coordinates")))
    two = F.to_json(F.struct(
        F.lit("MultiPolygon").alias("type"), F.array(F.array(ring(SHAPE)), F.array(ring(SECOND))).alias("coordinates")
    ))
    rows = load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("feature_id"), F.when(F.col("s_suppkey") % 2 == 1, two).otherwise(one).alias("geometry")
    )
    return gm.parse_geometry(rows)


def points(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen customers in the cell of every supplier."""
    cell = F.floor(F.col("c_custkey") / 15)
    x = (cell % ROW) * CELL + X0 + F.pmod(F.col("c_acctbal") * 7, F.lit(400.0))
    y = F.floor(cell / ROW) * CELL + Y0 + F.pmod(F.col("c_acctbal") * 13, F.lit(400.0))
    lat, lng = from_mercator(x, y)
    return load(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), lat.alias("lat"), lng.alias("lng"))


def _edges_sql(shape, part: int) -> str:
    return ", ".join(
        f"({part}, {x1}.0, {y1}.0, {x2}.0, {y2}.0)" for (x1, y1), (x2, y2) in zip(shape, shape[1:])
    )


@query(f"""
WITH edges(part, xi, yi, xj, yj) AS (VALUES {_edges_sql(SHAPE, 0)}, {_edges_sql(SECOND, 1)}),
p AS (
  SELECT c_custkey AS point_id, s_suppkey AS feature_id, ((c_acctbal * 7) % 400 + 400) % 400 AS px,
         ((c_acctbal * 13) % 400 + 400) % 400 AS py
  FROM customer JOIN supplier ON s_suppkey = c_custkey // 15)
SELECT DISTINCT point_id, feature_id FROM (
  SELECT point_id, feature_id, part, count(*) AS n FROM p, edges
  WHERE (yi > py) <> (yj > py) AND px < (xj - xi) * (py - yi) / (yj - yi) + xi AND (part = 0 OR feature_id % 2 = 1)
  GROUP BY ALL) WHERE n % 2 = 1
""")
def points_in_polygons(spark: SparkSession, d: str) -> DataFrame:
    return gm.points_in_polygons(points(spark, d), polygons(spark, d))


@query(f"""
SELECT s_suppkey AS feature_id, parte, vertice,
       round(lng, 6) AS lng, round(lat, 6) AS lat FROM (
  SELECT s_suppkey, parte, vertice, (s_suppkey % {ROW} * {CELL} + {X0} + x) * 180 / {HALF} AS lng,
         degrees(2 * atan(exp((s_suppkey // {ROW} * {CELL} + {Y0} + y) * pi() / {HALF})) - pi() / 2) AS lat
  FROM supplier JOIN (VALUES {", ".join(f"(0, {i}, {x}.0, {y}.0)" for i, (x, y) in enumerate(SHAPE))},
    {", ".join(f"(1, {i}, {x}.0, {y}.0)" for i, (x, y) in enumerate(SECOND))}) t(parte, vertice, x, y)
  ON parte = 0 OR s_suppkey % 2 = 1)
""")
def polygon_degrees(spark: SparkSession, d: str) -> DataFrame:
    shapes = polygons(spark, d).select("feature_id", gm.polygons_to_degrees(F.col("polygons")).alias("g"))
    parts = shapes.select("feature_id", F.posexplode("g").alias("parte", "rings"))
    corners = parts.select("feature_id", "parte", F.posexplode(F.get("rings", F.lit(0))).alias("vertice", "p"))
    return rounded(corners.select(
        "feature_id", "parte", "vertice", F.get("p", F.lit(0)).alias("lng"), F.get("p", F.lit(1)).alias("lat")
    ))


@query("""
SELECT c_custkey AS feature_id, c_nationkey AS provincia, CAST(c_custkey % 50 AS INTEGER) AS municipio, 0 AS agregado,
       CAST(c_custkey % 3 AS INTEGER) AS zona, CAST(c_custkey AS INTEGER) AS poligono,
       CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 9 END AS parcela,
       CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 1 END AS recinto,
       CASE WHEN c_custkey % 2 = 0 THEN 'TA' ELSE '' END AS uso_sigpac,
       CASE WHEN c_custkey % 2 = 0 THEN round((c_acctbal + 1000) * 13.7 / 10000, 4) ELSE 0.0 END AS superficie
FROM customer
""")
def parcel_properties(spark: SparkSession, d: str) -> DataFrame:
    """Property names in three spellings, and the parcel service's answer for half of them."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    spelled = F.when(key % 3 == 0, F.to_json(F.struct(
        nation.alias("provincia"), (key % 50).alias("mun"), F.lit(0).alias("zon"), key.alias("POLIGONO"), F.lit(9).alias("par"),
    ))).otherwise(F.to_json(F.struct(
        nation.alias("PROVINCIA"), (key % 50).alias("MUNICIPIO"), (key % 3).alias("zona"), key.alias("pol"), F.lit(9).alias("PARCELA"),
    )))
    answer = F.to_json(F.struct(
        F.array(nation.cast("bigint"), key % 50, F.lit(0).cast("bigint"), key % 3, key, F.lit(7).cast("bigint")).alias("id"),
        F.struct(((F.col("c_acctbal") + 1000) * 13.7).alias("dn_surface")).alias("parcelaInfo"),
        F.array(F.struct(F.lit(4).alias("recinto"), F.lit("TA").alias("uso_sigpac"))).alias("query"),
    ))
    rows = load(spark, d, "customer").select(
        key.alias("feature_id"), spelled.alias("properties"), F.when(key % 2 == 0, answer).otherwise(F.lit("{}")).alias("info")
    )
    return rounded(gm.normalise_properties(rows, "properties", "info"))
