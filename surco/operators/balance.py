"""Crop water balance, irrigation advice and forecast scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ine_code


def etc(et0: Column, kc: Column) -> Column:
    return F.round(et0 * kc, 2)


def deficit(need: Column, rain: Column) -> Column:
    """Water to add, never negative; null where a part is null."""
    gap = need - rain
    return F.round(F.when(gap < 0, F.lit(0.0)).otherwise(gap), 2)


def water_balance(df: DataFrame, kc: DataFrame, keys: tuple[str, ...] = ("cultivo",)) -> DataFrame:
    """Daily need and deficit per row; rows of crops without coefficient keep nulls."""
    out = df.join(kc.select(*keys, F.col("kc").alias("kc_aplicado")), list(keys), "left")
    out = out.withColumn("etc_mm", etc(F.col("et0_mm"), F.col("kc_aplicado")))
    return out.withColumn("deficit_hidrico_mm", deficit(F.col("etc_mm"), F.col("precipitacion_mm")))


def with_coefficient(requests: DataFrame, kc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with kc, rejected requests): crop and phase must both be known."""
    joined = requests.join(kc.select("cultivo", "fase", "kc"), ["cultivo", "fase"], "left")
    ok = joined.filter(F.col("kc").isNotNull())
    bad = joined.filter(F.col("kc").isNull()).drop("kc").withColumn("reason", F.lit("unknown crop or phase"))
    return ok, bad


def with_municipality(requests: DataFrame, parcels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with a municipality code, rejected requests).

    A request that brings neither a code nor days of its own takes the code of
    its parcel; a parcel that is not registered is rejected.
    """
    codes = parcels.select("parcela_id", ine_code("provincia", "municipio").alias("_code"))
    given = F.nullif("codigo_ine", F.lit(""))
    joined = requests.join(codes, "parcela_id", "left").withColumn("codigo_ine", F.coalesce(given, "_code"))
    own = F.coalesce(F.size("prevision") > 0, F.lit(False))
    fine = own | F.col("codigo_ine").isNotNull()
    ok = joined.filter(fine).select(*requests.columns)
    bad = joined.filter(~fine).select(*requests.columns).withColumn("reason", F.lit("parcel not found"))
    return ok, bad


DAY = (
    "struct<fecha:date,et0_mm:double,precipitacion_mm:double,"
    "prob_precipitacion:double,estado_cielo_desc:string>"
)


def forecast_input(requests: DataFrame, forecast: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per request and day: the request's own days if it has any, else the
    table's days of its municipality. Requests that find no day are returned apart.
    """
    own = F.coalesce(F.size("prevision") > 0, F.lit(False))
    keep = [c for c in requests.columns if c != "prevision"]
    inline = requests.filter(own).select(*keep, F.inline(F.col("prevision").cast(f"array<{DAY}>")))
    days = forecast.select(
        "codigo_ine",
        F.col("fecha_prevision").alias("fecha"),
        F.col("et0_evapotranspiracion").cast("double").alias("et0_mm"),
        F.col("precipitacion_mm").cast("double").alias("precipitacion_mm"),
        F.col("prob_precipitacion").cast("double").alias("prob_precipitacion"),
        "estado_cielo_desc",
    )
    asking = requests.filter(~own).select(*keep)
    looked = asking.join(days.withColumn("_hit", F.lit(True)), "codigo_ine", "left")
    found = looked.filter("_hit").select(*inline.columns)
    unmet = looked.filter(F.col("_hit").isNull()).select(
        *keep, F.lit("no forecast for the municipality").alias("reason")
    )
    return inline.unionByName(found), unmet


def recommend(requests: DataFrame, forecast: DataFrame, kc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(advice per request and day, rejected requests); missing amounts count as 0."""
    known, bad = with_coefficient(requests, kc)
    rows, unmet = forecast_input(known, forecast)
    filled = rows.fillna(0.0, ["et0_mm", "precipitacion_mm", "prob_precipitacion"])
    need = etc(F.col("et0_mm"), F.col("kc"))
    advice = filled.select(
        "parcela_id", "cultivo", "fase", "fecha", "et0_mm", need.alias("etc_mm"), "precipitacion_mm",
        deficit(need, F.col("precipitacion_mm")).alias("deficit_mm"),
        "prob_precipitacion", F.col("estado_cielo_desc").alias("estado_cielo"), F.col("kc").alias("kc_aplicado"),
    )
    columns = ["parcela_id", "cultivo", "fase", "reason"]
    return advice, bad.select(*columns).unionByName(unmet.select(*columns))


def nest_advice(advice: DataFrame) -> DataFrame:
    """One row per request with its days in date order (a forecast spans 16 days)."""
    day = F.struct(
        "fecha", "et0_mm", "etc_mm", "precipitacion_mm", "deficit_mm", "prob_precipitacion",
        "estado_cielo", "kc_aplicado",
    )
    return advice.groupBy("parcela_id", "cultivo", "fase").agg(
        F.array_sort(F.collect_list(day)).alias("recomendacion_dias")
    )


SCENARIOS = {
    # name: (ET0 percentile, rain percentile)
    "pesimista": ("et0_p75", "precip_p25"),
    "neutro": ("et0_p50", "precip_p50"),
    "optimista": ("et0_p25", "precip_p75"),
}


def scenarios(et0: DataFrame, rain: DataFrame, kc: DataFrame, keys: tuple[str, ...] = ("parcela_id",)) -> DataFrame:
    """Need and deficit per day under dry, middle and wet assumptions."""
    return scenario_columns(et0.join(rain, [*keys, "fecha"]), kc, keys)


def scenario_columns(quantiles: DataFrame, kc: DataFrame, keys: tuple[str, ...] = ("parcela_id",)) -> DataFrame:
    """The same from rows that hold the quantiles of both targets."""
    joined = quantiles.join(kc, list(keys))
    columns = []
    for name, (e, r) in SCENARIOS.items():
        need = etc(F.col(e), F.col("kc"))
        columns += [need.alias(f"etc_{name}"), deficit(need, F.col(r)).alias(f"deficit_{name}")]
    return joined.select(*keys, "fecha", "kc", *columns)


def forecast_payload(rows: DataFrame, requests: DataFrame, made_at: Column) -> DataFrame:
    """One JSON document per parcel with its forecast days in date order."""
    fields = [f"{kind}_{name}" for kind in ("deficit", "etc") for name in SCENARIOS]
    day = F.struct(F.date_format("fecha", "yyyy-MM-dd").alias("fecha"), *fields)
    nested = rows.groupBy("parcela_id").agg(
        F.array_sort(F.collect_list(day)).alias("escenarios"), F.max("kc").alias("kc_aplicado")
    )
    document = F.struct(
        "parcela_id", "codigo_ine", "cultivo", "fase", "kc_aplicado",
        F.date_format(made_at, "yyyy-MM-dd'T'HH:mm:ss").alias("generado_en"),
        F.size("escenarios").alias("dias_forecast"), "escenarios",
    )
    return nested.join(requests, "parcela_id").select("parcela_id", F.to_json(document).alias("payload"))
