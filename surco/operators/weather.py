"""Daily weather: forecasts, latest rows, soil means, municipalities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import first_number, ine_code, ntz, sky_state
from ..functions.fixed_values import DAILY_NAMES, SOURCE_FORECAST, SOURCE_OBSERVED
from .tables import keep_last


def label_source(df: DataFrame, as_of, day: str = "fecha", into: str = "fuente") -> DataFrame:
    """`forecast` for days after the day of `as_of`, else `observado_modelo`."""
    today = F.to_date(ntz(as_of))
    return df.withColumn(
        into, F.when(F.col(day) > today, F.lit(SOURCE_FORECAST)).otherwise(F.lit(SOURCE_OBSERVED))
    )


def hourly_to_daily(df: DataFrame, keys: Sequence[str], time_col: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, F.to_date(time_col).alias("fecha")).agg(*[F.avg(v).alias(v) for v in values])


def build_forecast(primary: DataFrame, secondary: DataFrame, asked_at: Column) -> DataFrame:
    """Primary forecast days with sky state, and humidity where the primary has none."""
    extra = secondary.select(
        "codigo_ine", "fecha_prevision",
        F.col("humedad_max").alias("_max"), F.col("humedad_min").alias("_min"),
        "estado_cielo_cod", "estado_cielo_desc",
    )
    joined = primary.join(extra, ["codigo_ine", "fecha_prevision"], "left")
    return (
        joined.withColumn("humedad_max", first_number("humedad_max", "_max"))
        .withColumn("humedad_min", first_number("humedad_min", "_min"))
        .withColumn("fecha_consulta", asked_at)
        .drop("_max", "_min")
    )


def latest_asof(df: DataFrame, keys: Sequence[str], day: str, as_of, ties: Sequence[str] = ()) -> DataFrame:
    """Latest row per key with `day` not after `as_of`."""
    past = df.filter(F.col(day) <= F.to_date(ntz(as_of)))
    return keep_last(past, keys, [day, *ties])


def weather_by_parcel(parcels: DataFrame, latest: DataFrame) -> DataFrame:
    """Parcels with the weather of their municipality; means need both parts."""
    coded = parcels.withColumn("codigo_ine", ine_code("provincia", "municipio"))
    w = latest.select(
        "codigo_ine",
        ((F.col("tmax").cast("double") + F.col("tmin").cast("double")) / 2).alias("temperatura"),
        ((F.col("humedad_max").cast("double") + F.col("humedad_min").cast("double")) / 2).alias("humedad_ambiental"),
        F.col("precipitacion_mm").cast("double").alias("precipitacion_mm"),
        F.col("et0_evapotranspiracion").cast("double").alias("et0"),
        F.col("radiacion_solar").cast("double").alias("radiacion_solar"),
        sky_state("estado_cielo_desc", "weather_code").alias("estado_cielo"),
    )
    return coded.join(w, "codigo_ine", "left")


def join_weather(parcels: DataFrame, forecast: DataFrame, as_of, ties: Sequence[str] = ()) -> DataFrame:
    return weather_by_parcel(parcels, latest_asof(forecast, ["codigo_ine"], "fecha_prevision", as_of, ties))


def asof_by_day(rows: DataFrame, daily: DataFrame, key: str, row_day: str, day: str,
                values: Sequence[str]) -> DataFrame:
    """Every row with the latest daily values at or before its own day.

    Instead of sorting the rows of a key, the daily table (one row per key and
    day) learns until when each row holds; it becomes dense over the days that
    occur, and the rows meet it by equality on key and day.
    """
    wanted = rows.select(key, F.col(row_day).alias("_day")).distinct().withColumn("_asked", F.lit(True))
    known = daily.select(key, F.col(day).alias("_day"), F.struct(F.col(day).alias("desde"), *values).alias("_v"))
    # A range frame takes in the rows of the same day, whichever side they come from.
    so_far = W.partitionBy(key).orderBy("_day").rangeBetween(W.unboundedPreceding, W.currentRow)
    dense = (
        known.unionByName(wanted, allowMissingColumns=True)
        .withColumn("_v", F.last("_v", ignorenulls=True).over(so_far))
        .filter("_asked")
        .select(key, "_day", "_v")
    )
    out = rows.withColumn("_day", F.col(row_day)).join(dense, [key, "_day"], "left")
    return out.select(*rows.columns, "_v.*")


def centroids(parcels: DataFrame) -> DataFrame:
    """Mean position of the parcels of every municipality; rows with gaps do not count."""
    full = parcels.dropna(subset=["lat", "lng", "provincia", "municipio"])
    return full.groupBy("provincia", "municipio").agg(
        F.avg(F.col("lat").cast("double")).alias("lat"), F.avg(F.col("lng").cast("double")).alias("lon")
    )


def wanted_municipalities(parcels: DataFrame) -> DataFrame:
    code = ine_code("provincia", "municipio")
    return centroids(parcels).select(
        code.alias("codigo_ine"),
        F.concat(F.lit("Municipio "), code).alias("nombre"),
        F.col("provincia").cast("string").alias("provincia"),
        "lat", "lon",
    )


def union_by_priority(frames: Sequence[DataFrame], keys: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """Union of frames with different columns; per key the row of the last frame stays."""
    tagged = [f.withColumn("_turn", F.lit(i)) for i, f in enumerate(frames)]
    whole = tagged[0]
    for f in tagged[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return keep_last(whole, keys, ["_turn", *ties]).drop("_turn")


def daily_contract(days: DataFrame, parcels: DataFrame) -> DataFrame:
    """Daily rows with the parcel's crop and place, in the order of the contract."""
    soil = [c for c in ("humedad_suelo_m3m3", "temp_suelo_c") if c in days.columns]
    return days.join(parcels.select("parcela_id", "cultivo", "lat", "lon"), "parcela_id").select(
        "parcela_id", "cultivo", "lat", "lon", "fecha", *DAILY_NAMES.values(), "fuente", *soil
    )
