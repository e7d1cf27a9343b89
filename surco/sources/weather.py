"""Landed weather payloads as daily rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pick_period
from ..functions.fixed_values import DAILY_NAMES, FORECAST_NAMES, SOIL_NAMES, SOURCE_HISTORY
from ..operators.weather import hourly_to_daily, label_source


def explode_columns(payloads: DataFrame, block: str, names: Mapping[str, str], keep: Iterable[str],
                    time_as: str = "fecha", payload: str = "payload") -> DataFrame:
    """One row per time step of a block that holds one array per variable."""
    fields = ",".join(["time:array<string>", *[f"{n}:array<double>" for n in names]])
    parsed = payloads.select(*keep, F.from_json(payload, f"{block} struct<{fields}>")[block].alias("b"))
    # A variable the payload lacks counts as an empty array, which pads with nulls.
    arrays = parsed.select(
        *keep, F.col("b.time").alias("time"),
        *[F.coalesce(f"b.{n}", F.array().cast("array<double>")).alias(n) for n in names],
    )
    steps = arrays.select(*keep, F.explode(F.arrays_zip("time", *names)).alias("s"))
    when = F.to_date("s.time") if time_as == "fecha" else F.col("s.time").cast("timestamp_ntz")
    return steps.select(*keep, when.alias(time_as), *[F.col(f"s.{n}").alias(a) for n, a in names.items()])


def primary_forecast(payloads: DataFrame) -> DataFrame:
    """Daily forecast rows per municipality, with the day's raw values as JSON."""
    names = {n: n for n in FORECAST_NAMES}
    days = explode_columns(payloads, "daily", names, ["codigo_ine"])
    raw = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("datos_raw")
    renamed = [F.col(n).alias(alias) for n, alias in FORECAST_NAMES.items()]
    return days.select("codigo_ine", F.col("fecha").alias("fecha_prevision"), *renamed, raw)


def official_forecast(payloads: DataFrame) -> DataFrame:
    """Daily rows of the nested official forecast: humidity and sky state."""
    item = "value:string,descripcion:string,periodo:string"
    day = (
        "fecha:string,humedadRelativa:struct<maxima:string,minima:string>,"
        f"estadoCielo:array<struct<{item}>>"
    )
    schema = f"array<struct<prediccion:struct<dia:array<struct<{day}>>>>>"
    document = F.get(F.from_json("payload", schema), F.lit(0))
    days = payloads.select("codigo_ine", F.explode(document["prediccion"]["dia"]).alias("d"))
    return days.select(
        "codigo_ine",
        F.to_date(F.substring("d.fecha", 1, 10)).alias("fecha_prevision"),
        F.col("d.humedadRelativa.maxima").alias("humedad_max"),
        F.col("d.humedadRelativa.minima").alias("humedad_min"),
        pick_period("d.estadoCielo").alias("estado_cielo_cod"),
        pick_period("d.estadoCielo", key="descripcion").alias("estado_cielo_desc"),
    )


def history(payloads: DataFrame) -> DataFrame:
    """Daily rows of the landed history blocks of every parcel."""
    return explode_columns(payloads, "daily", DAILY_NAMES, ["parcela_id"]).withColumn(
        "fuente", F.lit(SOURCE_HISTORY)
    )


def history_blocks(parcels: DataFrame, first_year: int, this_year: int, years: int = 5) -> DataFrame:
    """The date ranges of history to land for every parcel."""
    starts = F.sequence(F.lit(first_year), F.lit(this_year - 1), F.lit(years))
    blocks = parcels.select("*", F.explode(starts).alias("_y"))
    return blocks.select(
        *parcels.columns,
        F.make_date("_y", F.lit(1), F.lit(1)).alias("desde"),
        F.make_date(F.least(F.col("_y") + (years - 1), F.lit(this_year - 1)), F.lit(12), F.lit(31)).alias("hasta"),
    )


def recent_and_forecast(payloads: DataFrame, as_of) -> DataFrame:
    """Recent and forecast days with the daily means of the hourly soil block."""
    days = label_source(explode_columns(payloads, "daily", DAILY_NAMES, ["parcela_id"]), as_of)
    hours = explode_columns(payloads, "hourly", SOIL_NAMES, ["parcela_id"], time_as="hora")
    soil = hourly_to_daily(hours, ["parcela_id"], "hora", list(SOIL_NAMES.values()))
    return days.join(soil, ["parcela_id", "fecha"], "left")
