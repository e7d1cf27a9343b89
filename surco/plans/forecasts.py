"""Queries over daily weather, water balance and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ine_code, ntz
from ..functions.fixed_values import SOURCE_HISTORY
from ..operators import balance, forecast as fc, weather
from ..operators.tables import keep_last
from ..sources import weather as ws
from ..sources.tables import load, melt_coefficients
from . import roles
from .registry import query
from .roles import AS_OF, DAY_AS_OF, rounded


@query(f"""
WITH {roles.PARCELS}, {roles.LATEST_WEATHER}
SELECT id, codigo_ine, round(temperatura, 6) AS temperatura, humedad_ambiental,
       round(precipitacion_mm, 6) AS precipitacion_mm, round(et0, 6) AS et0,
       round(radiacion_solar, 6) AS radiacion_solar, estado_cielo
FROM parcel_weather
""")
def latest_weather_asof(spark: SparkSession, d: str) -> DataFrame:
    out = weather.join_weather(roles.parcels(spark, d), roles.forecast(spark, d), DAY_AS_OF, ["o_orderkey"])
    return rounded(out.select(
        "id", "codigo_ine", "temperatura", "humedad_ambiental", "precipitacion_mm", "et0", "radiacion_solar",
        "estado_cielo",
    ))


@query("""
WITH daily AS (
  SELECT l_partkey AS clave, CAST(l_shipdate AS DATE) AS fecha, l_quantity AS et0, l_extendedprice AS lluvia
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_partkey, l_shipdate
                             ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) = 1)
SELECT o.o_orderkey, o.o_custkey AS clave, CAST(o.o_orderdate AS DATE) AS dia, w.fecha AS desde, w.et0, w.lluvia
FROM orders o ASOF LEFT JOIN daily w ON o.o_custkey = w.clave AND CAST(o.o_orderdate AS DATE) >= w.fecha
""")
def reading_weather_asof(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").select(
        F.col("l_partkey").alias("clave"), F.to_date("l_shipdate").alias("fecha"),
        "l_extendedprice", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("et0"),
    )
    daily = keep_last(lines, ["clave", "fecha"], ["l_extendedprice", "l_orderkey", "l_linenumber", "et0"])
    daily = daily.withColumnRenamed("l_extendedprice", "lluvia")
    rows = load(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("clave"), F.to_date("o_orderdate").alias("dia")
    )
    return weather.asof_by_day(rows, daily, "clave", "dia", "fecha", ["et0", "lluvia"])


@query("""
WITH both_frames AS (
  SELECT 0 AS turno, o_custkey AS parcela_id, CAST(o_orderdate AS DATE) AS fecha, o_totalprice AS et0_mm,
         CAST(NULL AS DOUBLE) AS humedad_suelo, o_orderkey AS a, o_totalprice AS b FROM orders
  UNION ALL
  SELECT 1, l_suppkey, CAST(l_shipdate AS DATE), l_extendedprice, l_quantity, l_orderkey, l_extendedprice FROM lineitem)
SELECT parcela_id, fecha, et0_mm, humedad_suelo FROM both_frames
QUALIFY row_number() OVER (PARTITION BY parcela_id, fecha ORDER BY turno DESC, a DESC, b DESC) = 1
""")
def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    history = load(spark, d, "orders").select(
        F.col("o_custkey").alias("parcela_id"), F.to_date("o_orderdate").alias("fecha"),
        F.col("o_totalprice").alias("et0_mm"), F.col("o_orderkey").alias("a"), F.col("o_totalprice").alias("b"),
    )
    recent = load(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("parcela_id"), F.to_date("l_shipdate").alias("fecha"),
        F.col("l_extendedprice").alias("et0_mm"), F.col("l_quantity").alias("humedad_suelo"),
        F.col("l_orderkey").alias("a"), F.col("l_extendedprice").alias("b"),
    )
    out = weather.union_by_priority([history, recent], ["parcela_id", "fecha"], ["a", "b"])
    return out.select("parcela_id", "fecha", "et0_mm", "humedad_suelo")


@query(f"""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS fecha,
       CASE WHEN CAST(o_orderdate AS DATE) > DATE '{DAY_AS_OF}' THEN 'forecast' ELSE 'observado_modelo' END AS fuente
FROM orders
""")
def forecast_label(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("fecha"))
    return weather.label_source(rows, DAY_AS_OF)


@query("""
WITH dias AS (SELECT user_id, CAST(ts AS DATE) AS fecha, count(*) AS lecturas FROM events GROUP BY ALL),
     suelo AS (SELECT user_id, CAST(ts AS DATE) AS fecha, avg(value / 3.71828) AS humedad_suelo_m3m3
               FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT user_id, fecha, lecturas, round(humedad_suelo_m3m3, 6) AS humedad_suelo_m3m3
FROM dias LEFT JOIN suelo USING (user_id, fecha)
""")
def hourly_to_daily_mean_join(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    days = events.groupBy("user_id", F.to_date("ts").alias("fecha")).agg(F.count(F.lit(1)).alias("lecturas"))
    soil = events.filter(F.col("event_type") == "purchase").withColumn("humedad_suelo_m3m3", F.col("value") / 3.71828)
    means = weather.hourly_to_daily(soil, ["user_id"], "ts", ["humedad_suelo_m3m3"])
    return rounded(days.join(means, ["user_id", "fecha"], "left"))


def wide_parcels(spark: SparkSession, d: str) -> DataFrame:
    """Fields in provinces of many municipalities."""
    return roles.parcels(spark, d).withColumn("provincia", F.col("usuario_id")).withColumn(
        "municipio", (F.col("id") % 50).cast("int")
    )


CENTROIDS = roles.PARCELS + """, centros AS (
  SELECT usuario_id AS provincia, CAST(id % 50 AS INTEGER) AS municipio, avg(lat) AS lat, avg(lng) AS lon
  FROM parcels WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY ALL)"""


@query(f"""
WITH {CENTROIDS}
SELECT provincia, municipio, round(lat, 6) AS lat, round(lon, 6) AS lon FROM centros
""")
def municipality_centroid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weather.centroids(wide_parcels(spark, d)))


def observation(price: Column) -> dict[str, Column]:
    """Forecast variables made from one amount; the humidity is missing in part."""
    return {
        "temperature_2m_max": price / 10000,
        "temperature_2m_min": price / 23000,
        "precipitation_sum": price / 70919,
        "weather_code": F.floor(price % 100),
        "et0_fao_evapotranspiration": price / 53000,
        "relative_humidity_2m_max": F.when(price % 2 < 1, price % 100),
    }


def columnar_payload(rows: DataFrame, key: str, when: str, block: str, values: dict[str, Column]) -> DataFrame:
    """Per key and month one JSON text that holds one array per variable.

    The rows bring one value per key and time, so a payload has a month's steps at most.
    """
    step = F.struct(F.col(when).cast("string").alias("time"), *[v.alias(n) for n, v in values.items()])
    steps = rows.select(key, F.trunc(F.to_date(when), "month").alias("mes"), step.alias("s"))
    lists = steps.groupBy(key, "mes").agg(F.array_sort(F.collect_list("s")).alias("s"))
    arrays = F.struct(*[F.col(f"s.{n}").alias(n) for n in ["time", *values]])
    return lists.select(key, "mes", F.to_json(F.struct(arrays.alias(block)), {"ignoreNullFields": "false"}).alias("payload"))


@query("""
WITH segundo AS (
  SELECT l_suppkey AS clave, CAST(l_shipdate AS DATE) AS fecha, max(l_quantity) AS hmax, min(l_quantity) AS hmin,
         max(l_linenumber) AS codigo
  FROM lineitem GROUP BY ALL)
SELECT CAST(o_custkey AS VARCHAR) AS codigo_ine, CAST(o_orderdate AS DATE) AS fecha_prevision,
       round(o_totalprice / 10000, 6) AS tmax, round(o_totalprice / 23000, 6) AS tmin,
       round(o_totalprice / 70919, 6) AS precipitacion_mm, floor(o_totalprice % 100) AS weather_code,
       round(o_totalprice / 53000, 6) AS et0_evapotranspiracion,
       round(coalesce(CASE WHEN o_totalprice % 2 < 1 THEN o_totalprice % 100 END, hmax), 6) AS humedad_max,
       round(hmin, 6) AS humedad_min, CAST(codigo AS VARCHAR) AS estado_cielo_cod,
       CASE WHEN codigo IS NOT NULL THEN 'cielo ' || codigo END AS estado_cielo_desc,
       TIMESTAMP '2024-01-31 00:00:00' AS fecha_consulta
FROM (SELECT o_custkey, o_orderdate, max(o_totalprice) AS o_totalprice FROM orders GROUP BY ALL)
LEFT JOIN segundo ON clave = o_custkey AND fecha = CAST(o_orderdate AS DATE)
""")
def forecast_build(spark: SparkSession, d: str) -> DataFrame:
    """Both landed payloads, derived from orders and line items, unfolded and joined."""
    orders = load(spark, d, "orders").groupBy(
        F.col("o_custkey").cast("string").alias("codigo_ine"), F.to_date("o_orderdate").alias("dia")
    ).agg(F.max("o_totalprice").alias("o_totalprice"))
    primary = ws.primary_forecast(
        columnar_payload(orders, "codigo_ine", "dia", "daily", observation(F.col("o_totalprice")))
    )
    days = load(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("codigo_ine"), F.to_date("l_shipdate").alias("dia")
    ).agg(F.max("l_quantity").alias("hmax"), F.min("l_quantity").alias("hmin"), F.max("l_linenumber").alias("c"))
    # Odd codes come as one item without period, even ones as a list with periods.
    text = F.concat(F.lit("cielo "), F.col("c").cast("string"))

    def item(period: Column, value: Column, words: Column) -> Column:
        return F.struct(value.alias("value"), words.alias("descripcion"), period.alias("periodo"))

    none = F.lit(None).cast("string")
    code = F.col("c").cast("string")
    sky = F.when(F.col("c") % 2 == 1, F.array(item(none, code, text))).otherwise(
        F.array(item(F.lit("00-12"), F.lit("x"), F.lit("no")), item(F.lit("00-24"), code, text))
    )
    day = F.struct(
        F.concat(F.col("dia").cast("string"), F.lit("T00:00:00")).alias("fecha"),
        F.struct(F.col("hmax").alias("maxima"), F.col("hmin").alias("minima")).alias("humedadRelativa"),
        sky.alias("estadoCielo"),
    )
    month = F.trunc("dia", "month")
    lists = days.groupBy("codigo_ine", month).agg(F.collect_list(day).alias("dia"))
    document = F.to_json(F.array(F.struct(F.struct("dia").alias("prediccion"))))
    secondary = ws.official_forecast(lists.select("codigo_ine", document.alias("payload")))
    out = weather.build_forecast(primary, secondary, ntz(AS_OF))
    return rounded(out.select(
        "codigo_ine", "fecha_prevision", "tmax", "tmin", "precipitacion_mm", "weather_code",
        "et0_evapotranspiracion", "humedad_max", "humedad_min", "estado_cielo_cod", "estado_cielo_desc",
        "fecha_consulta",
    ))


KC = """kc AS (
  SELECT p_type AS cultivo, CASE f WHEN 0 THEN 'inicial' WHEN 1 THEN 'desarrollo' WHEN 2 THEN 'mediados' ELSE 'final' END AS fase,
         CASE f WHEN 0 THEN min(p_size) / 71.0 WHEN 1 THEN max(p_size) / 73.0
                WHEN 2 THEN CASE WHEN p_type <> 'PROMO' THEN avg(p_size) / 31 END ELSE avg(p_retailprice) / 1700 END AS kc
  FROM part, range(4) t(f) GROUP BY p_type, f)"""


def coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Crop coefficients: one crop per part type, the middle phase of one unknown."""
    crops = load(spark, d, "part").groupBy(F.col("p_type").alias("cultivo")).agg(
        (F.min("p_size") / 71.0).alias("kc_inicio"),
        (F.max("p_size") / 73.0).alias("kc_desarrollo"),
        F.when(F.col("cultivo") != "PROMO", F.avg("p_size") / 31).alias("kc_medio"),
        (F.avg("p_retailprice") / 1700).alias("kc_final"),
    )
    return melt_coefficients(crops)


@query(f"""
WITH {KC} SELECT cultivo, fase, round(kc, 6) AS kc FROM kc WHERE kc IS NOT NULL
""")
def crop_coefficients(spark: SparkSession, d: str) -> DataFrame:
    return rounded(coefficients(spark, d))


@query(f"""
WITH {KC}
SELECT l_orderkey, l_linenumber, l_partkey, p_type AS cultivo, round(l_extendedprice / 7133, 6) AS et0_mm,
       round(CASE WHEN l_returnflag <> 'R' THEN l_discount * 61 / 7.3 END, 6) AS precipitacion_mm,
       round(kc, 6) AS kc_aplicado, round(l_extendedprice / 7133 * kc, 2) AS etc_mm,
       round(greatest(round(l_extendedprice / 7133 * kc, 2)
                      - nullif(CASE WHEN l_returnflag <> 'R' THEN l_discount * 61 / 7.3 END, NULL), 0)
             + CASE WHEN kc IS NULL OR l_returnflag = 'R' THEN NULL ELSE 0 END, 2) AS deficit_hidrico_mm
FROM lineitem JOIN part ON p_partkey = l_partkey
LEFT JOIN kc ON cultivo = p_type AND fase = 'mediados'
""")
def water_balance(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").join(
        load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("cultivo")), "l_partkey"
    )
    days = lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "cultivo", (F.col("l_extendedprice") / 7133).alias("et0_mm"),
        F.when(F.col("l_returnflag") != "R", F.col("l_discount") * 61 / 7.3).alias("precipitacion_mm"),
    )
    middle = coefficients(spark, d).filter(F.col("fase") == "mediados")
    return rounded(balance.water_balance(days, middle))


PHASES = "['inicial', 'desarrollo', 'mediados', 'final', 'otra']"
REQUESTS = roles.PARCELS + f""", requests AS (
  SELECT parcela_id, codigo_ine, id, usuario_id,
         CASE WHEN cultivo = 'MACHINERY' THEN 'desconocido' ELSE (['ECONOMY', 'PROMO', 'STANDARD'])[id % 3 + 1] END AS cultivo,
         {PHASES}[id % 5 + 1] AS fase, cultivo = 'BUILDING' AS own FROM parcels)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    """One irrigation request per field; fields of one segment bring their own day, odd ones no code."""
    def choose(*names: str) -> Column:
        return F.get(F.array(*[F.lit(n) for n in names]), (F.col("id") % len(names)).cast("int"))

    own = F.struct(
        F.lit("2024-02-01").cast("date").alias("fecha"),
        (F.col("id") / 770).alias("et0_mm"),
        F.lit(None).cast("double").alias("precipitacion_mm"),
        F.lit(0.0).alias("prob_precipitacion"),
        F.lit("Propio").alias("estado_cielo_desc"),
    )
    p = roles.parcels(spark, d)
    return p.select(
        "parcela_id",
        F.when(F.col("id") % 2 == 0, ine_code("provincia", "municipio")).otherwise(F.lit("")).alias("codigo_ine"),
        F.when(F.col("cultivo") == "MACHINERY", F.lit("desconocido")).otherwise(choose("ECONOMY", "PROMO", "STANDARD")).alias("cultivo"),
        choose("inicial", "desarrollo", "mediados", "final", "otra").alias("fase"),
        F.when(F.col("cultivo") == "BUILDING", F.array(own)).otherwise(F.array().cast(f"array<{balance.DAY}>")).alias("prevision"),
    )


@query(f"""
WITH {KC}, {REQUESTS}, {roles.FORECAST}, known AS (
  SELECT r.*, kc FROM requests r JOIN kc USING (cultivo, fase) WHERE kc IS NOT NULL),
days AS (
  SELECT parcela_id, cultivo, fase, kc, DATE '2024-02-01' AS fecha, id / 770 AS et0, 0.0 AS lluvia, 0.0 AS prob,
         'Propio' AS cielo FROM known WHERE own
  UNION ALL
  SELECT parcela_id, cultivo, fase, kc, fecha_prevision, coalesce(et0_evapotranspiracion, 0),
         coalesce(precipitacion_mm, 0), coalesce(prob_precipitacion, 0), estado_cielo_desc
  FROM known JOIN forecast USING (codigo_ine) WHERE NOT own)
SELECT parcela_id, cultivo, fase, fecha, round(et0, 6) AS et0_mm, round(et0 * kc, 2) AS etc_mm,
       round(lluvia, 6) AS precipitacion_mm, round(greatest(round(et0 * kc, 2) - lluvia, 0), 2) AS deficit_mm,
       prob AS prob_precipitacion, cielo AS estado_cielo, round(kc, 6) AS kc_aplicado
FROM days
""")
def recommendation(spark: SparkSession, d: str) -> DataFrame:
    asked, _ = balance.with_municipality(requests(spark, d), roles.parcels(spark, d))
    advice, _ = balance.recommend(asked, roles.forecast(spark, d), coefficients(spark, d))
    return rounded(advice)


@query(f"""
WITH {KC}, {REQUESTS}
SELECT r.parcela_id, r.cultivo, r.fase, CASE WHEN kc IS NULL THEN 'unknown crop or phase'
       ELSE 'no forecast for the municipality' END AS reason
FROM requests r LEFT JOIN (SELECT * FROM kc WHERE kc IS NOT NULL) k USING (cultivo, fase)
WHERE kc IS NULL OR (NOT own AND id NOT IN (SELECT o_custkey FROM orders))
""")
def recommendation_rejects(spark: SparkSession, d: str) -> DataFrame:
    asked, unknown = balance.with_municipality(requests(spark, d), roles.parcels(spark, d))
    _, bad = balance.recommend(asked, roles.forecast(spark, d), coefficients(spark, d))
    return bad.unionByName(unknown.select(*bad.columns))


SCENARIO = """series AS (
  SELECT CAST(l_partkey AS VARCHAR) AS parcela_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS fecha,
         min(l_extendedprice / 7133) AS e25, avg(l_extendedprice / 7133) AS e50, max(l_extendedprice / 7133) AS e75,
         min(l_discount * 61 / 7.3) AS r25, avg(l_discount * 61 / 7.3) AS r50, max(l_discount * 61 / 7.3) AS r75
  FROM lineitem GROUP BY ALL),
esc AS (
  SELECT parcela_id, fecha, p_size / 31.7 AS kc,
         round(e75 * p_size / 31.7, 2) AS etc_pesimista, round(e50 * p_size / 31.7, 2) AS etc_neutro,
         round(e25 * p_size / 31.7, 2) AS etc_optimista, r25, r50, r75
  FROM series JOIN part ON CAST(p_partkey AS VARCHAR) = parcela_id),
scenarios AS (
  SELECT parcela_id, fecha, kc, etc_pesimista, etc_neutro, etc_optimista,
         round(greatest(etc_pesimista - r25, 0), 2) AS deficit_pesimista,
         round(greatest(etc_neutro - r50, 0), 2) AS deficit_neutro,
         round(greatest(etc_optimista - r75, 0), 2) AS deficit_optimista FROM esc)"""


def scenario_rows(spark: SparkSession, d: str) -> DataFrame:
    """Least, mean and most of every part and month stand for the percentiles."""
    lines = load(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("parcela_id"),
        F.to_date(F.date_trunc("month", F.col("l_shipdate"))).alias("fecha"),
        (F.col("l_extendedprice") / 7133).alias("e"), (F.col("l_discount") * 61 / 7.3).alias("r"),
    )

    def spread(column: str, name: str) -> list[Column]:
        return [F.min(column).alias(f"{name}_p25"), F.avg(column).alias(f"{name}_p50"), F.max(column).alias(f"{name}_p75")]

    both = lines.groupBy("parcela_id", "fecha").agg(*spread("e", "et0"), *spread("r", "precip"))
    kc = load(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("parcela_id"), (F.col("p_size") / 31.7).alias("kc")
    )
    et0 = both.select("parcela_id", "fecha", "et0_p25", "et0_p50", "et0_p75")
    rain = both.select("parcela_id", "fecha", "precip_p25", "precip_p50", "precip_p75")
    return balance.scenarios(et0, rain, kc)


@query(f"""
WITH {SCENARIO} SELECT * REPLACE (round(kc, 6) AS kc) FROM scenarios
""")
def scenarios(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scenario_rows(spark, d))


@query(f"""
WITH {SCENARIO}
SELECT s.parcela_id, p_brand AS cultivo, 14 AS dias_min, s.fecha, s.etc_neutro, s.deficit_pesimista,
       count(*) OVER (PARTITION BY s.parcela_id) AS dias_forecast, '2024-01-31T00:00:00' AS generado_en
FROM scenarios s JOIN part ON CAST(p_partkey AS VARCHAR) = s.parcela_id
""")
def forecast_payload(spark: SparkSession, d: str) -> DataFrame:
    """The JSON documents, read back and unfolded."""
    asked = load(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("parcela_id"), F.col("p_type").alias("codigo_ine"),
        F.col("p_brand").alias("cultivo"), F.lit("mediados").alias("fase"),
    )
    documents = balance.forecast_payload(scenario_rows(spark, d), asked, ntz(AS_OF))
    day = "fecha:string,deficit_pesimista:double,deficit_neutro:double,deficit_optimista:double,etc_neutro:double"
    read = documents.select("parcela_id", F.from_json(
        "payload", f"cultivo string, generado_en string, dias_forecast bigint, escenarios array<struct<{day}>>"
    ).alias("p"))
    rows = read.select("parcela_id", "p.cultivo", "p.dias_forecast", "p.generado_en", F.explode("p.escenarios").alias("e"))
    return rows.select(
        "parcela_id", "cultivo", F.lit(14).alias("dias_min"), F.to_date("e.fecha").alias("fecha"), "e.etc_neutro",
        "e.deficit_pesimista", "dias_forecast", "generado_en",
    )


# ---- daily series ---------------------------------------------------------

def daily_rows(spark: SparkSession, d: str) -> DataFrame:
    """Landed history and recent days of every field, as one deduplicated series."""
    orders = load(spark, d, "orders").groupBy(
        F.col("o_custkey").cast("string").alias("parcela_id"), F.to_date("o_orderdate").alias("dia")
    ).agg(F.max("o_totalprice").alias("o_totalprice"))
    price = F.col("o_totalprice")
    old = ws.history(columnar_payload(orders, "parcela_id", "dia", "daily", {
        "temperature_2m_mean": price / 13000, "precipitation_sum": price / 70919,
        "et0_fao_evapotranspiration": price / 53000,
    }))
    events = load(spark, d, "events").withColumn("parcela_id", F.col("user_id").cast("string"))
    per_day = events.groupBy("parcela_id", F.to_date("ts").alias("dia")).agg(F.sum("value").alias("v"))
    block = columnar_payload(per_day, "parcela_id", "dia", "daily", {
        "temperature_2m_mean": F.col("v") / 17, "precipitation_sum": F.col("v") / 709,
        "et0_fao_evapotranspiration": F.col("v") / 53,
    })
    per_hour = events.groupBy("parcela_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.avg("value").alias("v"))
    soil = columnar_payload(per_hour, "parcela_id", "h", "hourly", {"soil_moisture_0_to_7cm": F.col("v") / 371.828})
    both = block.join(soil.withColumnRenamed("payload", "soil"), ["parcela_id", "mes"]).withColumn(
        "payload", F.concat(F.regexp_replace("payload", r"\}$", ","), F.regexp_replace("soil", r"^\{", ""))
    )
    recent = ws.recent_and_forecast(both.select("parcela_id", "payload"), "2024-01-20")
    return weather.union_by_priority([old, recent], ["parcela_id", "fecha"], ["et0_mm"])


@query(f"""
WITH {KC}, viejo AS (
  SELECT CAST(o_custkey AS VARCHAR) AS parcela_id, CAST(o_orderdate AS DATE) AS fecha,
         o_totalprice / 13000 AS temp_media_c, o_totalprice / 70919 AS precipitacion_mm, o_totalprice / 53000 AS et0_mm,
         'historico_era5' AS fuente, CAST(NULL AS DOUBLE) AS humedad_suelo_m3m3 FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_totalprice DESC) = 1),
horas AS (SELECT user_id, date_trunc('hour', ts) AS h, avg(value) / 371.828 AS v FROM events GROUP BY ALL),
suelo AS (SELECT user_id, CAST(h AS DATE) AS fecha, avg(v) AS v FROM horas GROUP BY ALL),
dias AS (SELECT user_id, CAST(ts AS DATE) AS fecha, sum(value) AS v FROM events GROUP BY ALL),
nuevo AS (
  SELECT CAST(user_id AS VARCHAR) AS parcela_id, fecha, dias.v / 17 AS temp_media_c, dias.v / 709 AS precipitacion_mm,
         dias.v / 53 AS et0_mm, CASE WHEN fecha > DATE '2024-01-20' THEN 'forecast' ELSE 'observado_modelo' END AS fuente,
         suelo.v AS humedad_suelo_m3m3 FROM dias LEFT JOIN suelo USING (user_id, fecha)),
serie AS (SELECT * FROM viejo UNION ALL SELECT * FROM nuevo)
SELECT parcela_id, p_type AS cultivo, fecha, round(temp_media_c, 6) AS temp_media_c, fuente,
       round(humedad_suelo_m3m3, 6) AS humedad_suelo_m3m3, round(kc, 6) AS kc_aplicado,
       round(et0_mm * kc, 2) AS etc_mm,
       CASE WHEN kc IS NOT NULL THEN round(greatest(round(et0_mm * kc, 2) - precipitacion_mm, 0), 2) END AS deficit_hidrico_mm
FROM serie JOIN part ON CAST(p_partkey AS VARCHAR) = parcela_id
LEFT JOIN kc ON kc.cultivo = p_type AND fase = 'mediados'
""")
def daily_series(spark: SparkSession, d: str) -> DataFrame:
    """History and recent payloads to the daily table with its water balance."""
    fields = load(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("parcela_id"), F.col("p_type").alias("cultivo"),
        F.lit(39.0).alias("lat"), F.lit(-0.3).alias("lon"),
    )
    rows = weather.daily_contract(daily_rows(spark, d), fields)
    middle = coefficients(spark, d).filter(F.col("fase") == "mediados")
    return rounded(balance.water_balance(rows, middle).select(
        "parcela_id", "cultivo", "fecha", "temp_media_c", "fuente", "humedad_suelo_m3m3", "kc_aplicado", "etc_mm",
        "deficit_hidrico_mm",
    ))


# ---- forecasting ----------------------------------------------------------

HISTORY_END = "1998-01-01"


def nation_series(spark: SparkSession, d: str) -> DataFrame:
    """One daily series per nation: reduced to a row per day before any fitting; days from 1998 on are no history."""
    orders = load(spark, d, "orders").join(
        load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"
    )
    daily = orders.groupBy(
        F.col("c_nationkey").cast("string").alias("parcela_id"), F.to_date("o_orderdate").alias("fecha")
    ).agg(
        (F.avg("o_totalprice") / 50021).alias("et0_mm"),
        F.when(F.max("o_orderpriority") != "5-LOW", F.max("o_totalprice") / 100003).alias("precipitacion_mm"),
    )
    history = F.when(F.col("fecha") < HISTORY_END, F.lit(SOURCE_HISTORY)).otherwise(F.lit("prevision"))
    return fc.training_series(daily.withColumn("fuente", history))


TRAINING = f"""diario AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS parcela_id, CAST(o_orderdate AS DATE) AS fecha, avg(o_totalprice) / 50021 AS et0_mm,
         CASE WHEN max(o_orderpriority) <> '5-LOW' THEN max(o_totalprice) / 100003 END AS precipitacion_mm,
         CASE WHEN CAST(o_orderdate AS DATE) < DATE '{HISTORY_END}' THEN '{SOURCE_HISTORY}' ELSE 'prevision' END AS fuente
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
serie AS (
  SELECT parcela_id, 'et0' AS target, fecha AS ds, et0_mm AS y FROM diario WHERE fuente = '{SOURCE_HISTORY}' AND et0_mm IS NOT NULL
  UNION ALL
  SELECT parcela_id, 'precip', fecha, precipitacion_mm FROM diario WHERE fuente = '{SOURCE_HISTORY}' AND precipitacion_mm IS NOT NULL)"""


@query(f"WITH {TRAINING} SELECT parcela_id, target, ds, round(y, 6) AS y FROM serie")
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nation_series(spark, d))


def features_sql(mode: str) -> list[str]:
    """The features of the closed-form model of day `d`, counted from 1970."""
    t = f"((d - {fc.DAY_ZERO}) / {fc.YEAR})"
    waves = [f"{f}(2 * pi() * (d / {fc.YEAR}) * {h})" for f in ("cos", "sin") for h in range(1, fc.WAVES + 1)]
    return ["1.0", t, *waves, *([f"{w} * {t}" for w in waves] if mode == "multiplicative" else [])]


def fit_sql(name: str, rows: str, keys: str, mode: str) -> str:
    """`{name}(keys, b0, b1, ..., spread)`: least squares of `rows(keys, d, y)` by elimination, one pivot a step."""
    x = features_sql(mode)
    n = range(len(x))
    parts = [f"{name}_x AS (SELECT {keys}, y, {', '.join(f'{e} AS f{i}' for i, e in enumerate(x))} FROM {rows})"]
    sums = [f"sum(f{i} * f{j}){f' + {fc.RIDGE}' if i == j else ''} AS a{i}_{j}" for i in n for j in n if i <= j]
    sums += [f"sum(f{i} * y) AS r{i}, sum(f{i} * y) AS o{i}" for i in n]
    parts.append(f"{name}_0 AS (SELECT {keys}, sum(y * y) AS yy, count(*) AS n, {', '.join(sums)} FROM {name}_x GROUP BY ALL)")
    for k in n[:-1]:
        step = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in n for j in n if k < i <= j]
        step += [f"r{i} - a{k}_{i} * r{k} / a{k}_{k} AS r{i}" for i in n if i > k]
        parts.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT * REPLACE ({', '.join(step)}) FROM {name}_{k})")
    last = f"{name}_{len(x) - 1}"
    for k in reversed(n):
        rest = "".join(f" - a{k}_{j} * b{j}" for j in n if j > k)
        parts.append(f"{name}_b{k} AS MATERIALIZED (SELECT *, (r{k}{rest}) / a{k}_{k} AS b{k} FROM {last})")
        last = f"{name}_b{k}"
    left = f"yy{''.join(f' - b{i} * o{i} - {fc.RIDGE} * b{i} * b{i}' for i in n)}"
    parts.append(f"{name} AS (SELECT {keys}, {', '.join(f'b{i}' for i in n)}, sqrt(greatest(0, {left}) / n) AS spread FROM {last})")
    return ", ".join(parts)


def value_sql(mode: str) -> str:
    return " + ".join(f"b{i} * {e}" for i, e in enumerate(features_sql(mode)))


DAYS = "datediff('day', DATE '1970-01-01', ds) AS d"
MODES = {t: (mode, log) for t, (_, mode, log) in fc.TARGETS.items()}


def logged(target: str) -> str:
    return "ln(1 + y)" if MODES[target][1] else "y"


FORECAST_SQL = f"WITH {TRAINING}" + "".join(f""", {t}_rows AS (SELECT parcela_id, {DAYS}, {logged(t)} AS y FROM serie WHERE target = '{t}'),
{fit_sql(t, f'{t}_rows', 'parcela_id', mode)},
{t}_days AS (SELECT parcela_id, unnest(range(max(d) + 1, max(d) + 15)) AS d FROM {t}_rows GROUP BY 1),
{t}_middle AS (SELECT parcela_id, '{t}' AS target, DATE '1970-01-01' + CAST(d AS INTEGER) AS fecha, {value_sql(mode)} AS m, spread * {fc.QUARTILE} AS s
  FROM {t}_days JOIN {t} USING (parcela_id)),
{t}_out AS (
  SELECT parcela_id, target, fecha, {', '.join(f"round(greatest(0, {'exp(%s) - 1' if log else '%s'}), 2) AS {c}" % e for c, e in (('p50', 'm'), ('p25', 'm - s'), ('p75', 'm + s')))}
  FROM {t}_middle)""" for t, (mode, log) in MODES.items())


@query(FORECAST_SQL + "".join(f"{' UNION ALL' if i else ''} SELECT * FROM {t}_out" for i, t in enumerate(MODES)))
def seasonal_forecast(spark: SparkSession, d: str) -> DataFrame:
    """The closed form over every nation's history; SQL solves the same equations."""
    return fc.moment_forecast(nation_series(spark, d))


CUTS = """cortes AS (
  SELECT parcela_id, target, unnest(range(0, (ultimo - primero - 1825) // 90 + 1)) AS paso, ultimo
  FROM (SELECT parcela_id, target, min(ds) AS primero, max(ds) - 14 AS ultimo FROM serie GROUP BY 1, 2) WHERE ultimo - primero >= 1825),
pruebas AS (
  SELECT c.parcela_id, c.target, ultimo - CAST(paso * 90 AS INTEGER) AS corte, ds, CAST(ds - corte AS INTEGER) AS horizonte, y
  FROM cortes c JOIN serie s ON s.parcela_id = c.parcela_id AND s.target = c.target AND ds > ultimo - CAST(paso * 90 AS INTEGER)
    AND ds <= ultimo - CAST(paso * 90 AS INTEGER) + 14)"""


@query(f"WITH {TRAINING}, {CUTS} SELECT * REPLACE (round(y, 6) AS y) FROM pruebas")
def walk_forward_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a walk-forward validation has to predict: cutoff, day, horizon and actual value."""
    return rounded(fc.walk_forward_rows(nation_series(spark, d)))


WALKED = f"WITH {TRAINING}, {CUTS}" + "".join(f""", {t}_rows AS (
  SELECT c.parcela_id, c.corte, {DAYS}, {logged(t)} AS y FROM (SELECT DISTINCT parcela_id, corte FROM pruebas WHERE target = '{t}') c
  JOIN serie s ON s.parcela_id = c.parcela_id AND s.target = '{t}' AND ds <= corte),
{fit_sql(t, f'{t}_rows', 'parcela_id, corte', mode)},
{t}_out AS (
  SELECT p.*, {logged(t)} AS actual, {value_sql(mode)} AS yhat, spread * {fc.QUARTILE} AS s
  FROM (SELECT *, {DAYS} FROM pruebas WHERE target = '{t}') p JOIN {t} USING (parcela_id, corte))""" for t, (mode, _) in MODES.items()) + """,
andado AS (SELECT parcela_id, target, corte, ds, horizonte, actual AS y, yhat, yhat - s AS yhat_lower, yhat + s AS yhat_upper FROM (""" + " UNION ALL ".join(
    f"SELECT * FROM {t}_out" for t in MODES) + "))"


@query(WALKED + " SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in ("y", "yhat", "yhat_lower", "yhat_upper")) + ") FROM andado")
def walk_forward_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Every predicted day of every cutoff: series, cutoff and target are rows, fitted from running sums."""
    return rounded(fc.moment_walk_forward(nation_series(spark, d)))


@query(WALKED + """,
per AS (
  SELECT parcela_id, target, horizonte, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs((y - yhat) / y)) AS mape
  FROM andado GROUP BY ALL)
SELECT parcela_id, target, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(mape), 6) AS mape FROM per GROUP BY ALL
""")
def walk_forward_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.forecast_errors(fc.moment_walk_forward(nation_series(spark, d)), ("parcela_id", "target")))


def scenario_sql(name: str, e: str, r: str) -> str:
    need = f"round(e.{e} * kc, 2)"
    return f"{need} AS etc_{name}, CASE WHEN r.{r} IS NOT NULL THEN round(greatest({need} - r.{r}, 0), 2) END AS deficit_{name}"


@query(FORECAST_SQL + f""", factor AS (SELECT CAST(n_nationkey AS VARCHAR) AS parcela_id, (n_regionkey + 7) / 9.83 AS kc FROM nation)
SELECT e.parcela_id, e.fecha, round(kc, 6) AS kc, {scenario_sql('pesimista', 'p75', 'p25')}, {scenario_sql('neutro', 'p50', 'p50')},
       {scenario_sql('optimista', 'p25', 'p75')}
FROM et0_out e JOIN factor USING (parcela_id) LEFT JOIN precip_out r USING (parcela_id, fecha)
""")
def seasonal_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Fitted quantiles of both targets to scenarios, end to end."""
    predicted = fc.moment_forecast(nation_series(spark, d))
    kc = load(spark, d, "nation").select(
        F.col("n_nationkey").cast("string").alias("parcela_id"), ((F.col("n_regionkey") + 7) / 9.83).alias("kc")
    )
    wide = fc.quantiles_wide(predicted).filter(F.col("et0_p50").isNotNull())
    return rounded(balance.scenario_columns(wide, kc))


@query()
def fitted_forecast(spark: SparkSession, d: str) -> DataFrame:
    """The iterative model with changes of trend and ten waves."""
    return fc.fit_predict(nation_series(spark, d))


@query("""
WITH per AS (
  SELECT l_returnflag AS target, l_linenumber AS horizonte, avg(abs(l_quantity - l_extendedprice / 2000)) AS mae,
         sqrt(avg((l_quantity - l_extendedprice / 2000) * (l_quantity - l_extendedprice / 2000))) AS rmse,
         avg(abs((l_quantity - l_extendedprice / 2000) / l_quantity)) AS mape
  FROM lineitem GROUP BY ALL)
SELECT target, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(mape), 6) AS mape FROM per GROUP BY target
""")
def forecast_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("target"), F.col("l_linenumber").alias("horizonte"),
        F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 2000).alias("yhat"),
    )
    return rounded(fc.forecast_errors(rows))
