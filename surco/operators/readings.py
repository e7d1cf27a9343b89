"""Windowed sensor averages and their enrichment. Batch and streaming alike.

Readings carry entity_type, entity_id, user_id, sensor_tipo, valor, sensor_id,
event_time and message_id. No join here names a broadcast side: the dimension
tables grow with the data, so Spark's size threshold and adaptive execution
decide between broadcasting and a shuffle with skew splitting.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, lookup
from ..functions.fixed_values import DEVICE_CLASSES, METRICS, MISSING_STATES, SENSOR_NAMES, SWITCHABLE_DOMAINS

ARRIVAL = ("event_time", "message_id")

# What the baseline takes of a parcel and its weather.
PARCEL_WEATHER = (
    "entity_id", "user_id", "nombre", "temperatura", "humedad_ambiental", "precipitacion_mm", "et0", "radiacion_solar",
    "cultivo", "variedad", "estado_cielo",
)


def arrival() -> Column:
    """Readings of a group are ordered by event time, then message id."""
    return F.struct(*ARRIVAL)


# ---- row operators --------------------------------------------------------

def route(readings: DataFrame, entity_types: Iterable[str]) -> DataFrame:
    return readings.filter(F.col("entity_type").isin(*entity_types))


def coerce_numeric(df: DataFrame, column: str = "valor") -> DataFrame:
    """Text to numbers; what is no finite number becomes null."""
    return df.withColumn(column, finite(column))


def drop_non_numeric(df: DataFrame, column: str = "valor") -> tuple[DataFrame, DataFrame]:
    """Rows with a finite number, and the rest."""
    number = finite(column)
    kept = df.withColumn("_number", number)
    ok = kept.filter(F.col("_number").isNotNull()).drop(column).withColumnRenamed("_number", column)
    bad = kept.filter(F.col("_number").isNull()).drop("_number")
    return ok.select(*df.columns), bad


def map_vocabulary(df: DataFrame, column: str, mapping: Mapping[str, str] = SENSOR_NAMES,
                   keep_unknown: bool = True) -> DataFrame:
    """Rename values; unknown ones pass through, or their rows drop out."""
    renamed = lookup(mapping, column)
    if keep_unknown:
        return df.withColumn(column, F.coalesce(renamed, F.col(column)))
    return df.filter(F.col(column).isin(*mapping)).withColumn(column, renamed)


def filter_domain(df: DataFrame, domains: Iterable[str], column: str = "entity_id") -> DataFrame:
    """Entities whose id starts with one of the domains, with that domain."""
    name = F.col(column)
    domain = F.when(name.contains("."), F.split_part(name, F.lit("."), F.lit(1)))
    return df.withColumn("domain", domain).filter(F.col("domain").isin(*domains))


# ---- windowed averages ----------------------------------------------------

def _of_type(kind: str, value: str = "valor") -> Column:
    return F.when(F.col("sensor_tipo") == kind, F.col(value))


def sensor_pivot(readings: DataFrame, key: str = "entity_id", every: str = "1 hour",
                 types: Mapping[str, str] | None = None, round_to: int | None = 4,
                 drop_empty: bool = True) -> DataFrame:
    """One row per entity and window, one averaged column per sensor type."""
    types = types or {m: m for m in METRICS}
    means = []
    for name, kind in types.items():
        mean = F.avg(_of_type(kind))
        means.append((F.round(mean, round_to) if round_to is not None else mean).alias(name))
    grouped = readings.groupBy(F.window("event_time", every).alias("w"), key)
    # The least struct carries the first reading's user along in one buffer.
    first = F.min(F.struct(*ARRIVAL, "user_id"))["user_id"]
    out = grouped.agg(first.alias("user_id"), *means)
    if drop_empty:
        out = out.filter(F.coalesce(*types).isNotNull())
    return out.select(
        "user_id", key, F.col("w.start").alias("timestamp"), *types,
        F.when(F.col("temperatura").isNotNull(), F.lit("sensor")).alias("fuente_temperatura"),
    )


def enrich(rows: DataFrame, dimension: DataFrame, key: str = "entity_id") -> DataFrame:
    """Attributes of the entity; unknown entities keep their rows."""
    return rows.join(dimension, key, "left")


def field_rows(pivoted: DataFrame, parcels: DataFrame) -> DataFrame:
    """Hourly rows in the layout of the field readings table."""
    nothing = F.lit(None)
    return enrich(pivoted, parcels).select(
        F.coalesce("user_id", F.lit("")).alias("user_id"),
        F.col("parcela_id").alias("parcel_id"),
        "timestamp", *METRICS,
        nothing.cast("double").alias("precipitacion_mm"),
        nothing.cast("double").alias("et0"),
        nothing.cast("double").alias("radiacion_solar"),
        "fuente_temperatura",
        F.col("cultivo").alias("tipo_cultivo"),
        "variedad",
        nothing.cast("date").alias("fecha_plantacion_aprox"),
    )


def sensor_windows(sensors: DataFrame, every: str = "10 minutes", beside: Sequence[str] = ()) -> DataFrame:
    """Sensor means per entity and window, with the first non-empty sensor id; `beside` are further keys."""
    has_id = F.when(F.col("sensor_id") != "", arrival())
    closed = sensors.groupBy(F.window("event_time", every).alias("w"), *beside, "entity_id").agg(
        F.min_by("sensor_id", has_id).alias("sensor_id"), *[F.avg(_of_type(m)).alias(f"_{m}") for m in METRICS])
    return closed.select("*", F.col("w.start").cast("timestamp_ntz").alias("timestamp")).drop("w")


def baseline_windows(sensors: DataFrame, ticks: DataFrame, every: str = "10 minutes") -> DataFrame:
    """Sensor means per entity and window beside the windows that ticked (`tick`), for tables and streams.

    Both meet in one windowed aggregate: a single shuffle, and no join state on
    a stream. `ticks` brings event_time and message_id.
    """
    both = sensors.withColumn("tick", F.lit(False)).unionByName(
        ticks.select("event_time", "message_id", F.lit(True).alias("tick")), allowMissingColumns=True)
    return sensor_windows(both, every, ["tick"])


def day_spine(rows: DataFrame, bounds: Column, every: str = "10 minutes") -> DataFrame:
    """Every row once per day from `bounds.first` to `bounds.last`, as `_day`, with the starts of that day's first and last window, `_from` and `_to`.

    `bounds` holds the starts of the first and last window, both aligned; a day
    must be a whole number of windows. Without bounds there are no rows.
    """
    day = F.explode(F.sequence(F.to_date(bounds["first"]), F.to_date(bounds["last"])))
    begin = F.col("_day").cast("timestamp_ntz")
    ends = begin + F.expr("INTERVAL '1 day'") - F.expr(f"INTERVAL '{every}'")
    return rows.withColumn("_day", day).withColumns({"_from": F.greatest(bounds["first"], begin), "_to": F.least(bounds["last"], ends)})


def day_windows(every: str = "10 minutes") -> Column:
    """The window starts of a row of `day_spine`."""
    return F.sequence("_from", "_to", F.expr(f"INTERVAL '{every}'"))


def window_spine(rows: DataFrame, bounds: Column, every: str = "10 minutes") -> DataFrame:
    """The rows of `day_spine` with that day's windows as `windows`."""
    return day_spine(rows, bounds, every).withColumn("windows", day_windows(every)).drop("_from", "_to")


def override_baseline(sensors: DataFrame, ticked: DataFrame, parcels_weather: DataFrame, every: str = "10 minutes") -> DataFrame:
    """Every known parcel in every window from the first to the last of `ticked(timestamp)`, its sensors over its weather.

    Windows between two ticks count also if their own tick is missing. Parcels
    and sensor means meet once per day, so what is shuffled is a row per parcel
    and day; the windows of a day, a bounded number, unfold after that.
    """
    return unfold_days(baseline_days(sensors, ticked, parcels_weather, every), every)


def baseline_days(sensors: DataFrame, ticked: DataFrame, parcels_weather: DataFrame, every: str = "10 minutes") -> DataFrame:
    """Every known parcel once per day of the spine, with the windows its sensors were heard in as `_seen`."""
    bounds = ticked.agg(F.struct(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))).scalar()
    means = [f"_{m}" for m in METRICS]
    seen = sensors.groupBy("entity_id", F.to_date("timestamp").alias("_day")).agg(
        F.collect_list(F.struct("timestamp", "sensor_id", *means)).alias("_seen"))
    return day_spine(parcels_weather.select(*PARCEL_WEATHER), bounds, every).join(seen, ["entity_id", "_day"], "left")


def unfold_days(days: DataFrame, every: str = "10 minutes", latest: bool = False) -> DataFrame:
    """The rows of `baseline_days` as a row per window, those of a day in time order.

    With `latest`, only the windows that can hold the latest value of a field: those that were
    heard, and the day's last, since a quiet window has nothing that the last has not.
    A window that was heard more than once has a row for each.
    """
    at, windows = F.col("_seen.timestamp"), day_windows(every)
    days = days.withColumn("_at", at)
    if latest:
        windows = F.array_union(F.array("_to"), F.coalesce(F.array_intersect("_at", windows), F.array().cast("array<timestamp_ntz>")))
    # Repeats apart, a window is looked up in the day's few heard ones by generated code.
    repeated = F.size(F.array_distinct("_at")) < F.size("_at")
    repeats = F.filter("_at", lambda t, i: F.array_contains(day_windows(every), t) & (F.array_position("_at", t) <= i))
    days = days.withColumn("_all", F.when(repeated, F.sort_array(F.concat(windows, repeats)))).withColumns(
        {c: F.when(F.col("_all").isNotNull(), F.sort_array(c)).otherwise(F.col(c)) for c in ("_seen", "_at")})
    rows = days.select("*", F.posexplode(F.coalesce("_all", windows)).alias("_nth", "timestamp"))
    again = F.when(F.col("_all").isNotNull(), F.col("_nth") + 1 - F.array_position("_all", F.col("timestamp"))).otherwise(F.lit(0))
    rows = rows.withColumn("_heard", F.get("_seen", F.array_position("_at", F.col("timestamp")) - 1 + again))
    sensor = {m: F.col("_heard")[f"_{m}"] for m in METRICS}
    return rows.select(
        "user_id", F.col("entity_id").alias("parcel_id"), "nombre", "timestamp",
        F.coalesce(sensor["temperatura"], "temperatura").alias("temperatura"),
        F.coalesce(sensor["humedad_ambiental"], "humedad_ambiental").alias("humedad_ambiental"),
        sensor["humedad_suelo"].alias("humedad_suelo"),
        "precipitacion_mm", "et0", "radiacion_solar",
        F.when(sensor["temperatura"].isNotNull(), F.lit("sensor")).otherwise(F.lit("openmeteo")).alias("fuente_temperatura"),
        F.col("cultivo").alias("tipo_cultivo"), "variedad",
        F.lit(None).cast("date").alias("fecha_plantacion_aprox"), "estado_cielo", F.col("_heard")["sensor_id"].alias("sensor_id"),
    )


# ---- greenhouse to plant --------------------------------------------------

def plants_with_owner(plants: DataFrame, greenhouses: DataFrame) -> DataFrame:
    """Plants take the owner of their greenhouse, null where that is missing."""
    owners = greenhouses.select(
        F.col("id").cast("string").alias("greenhouse_id"), F.col("usuario_id").cast("string").alias("user_id"),
        F.lit(True).alias("has_greenhouse"),
    )
    return (
        plants.select(
            F.col("id").cast("string").alias("plant_id"),
            F.col("invernadero_id").cast("string").alias("greenhouse_id"),
            "tipo", "variedad",
        )
        .join(owners, "greenhouse_id", "left")
        .withColumn("has_greenhouse", F.coalesce("has_greenhouse", F.lit(False)))
    )


def window_partials(readings: DataFrame, every: str = "5 minutes") -> DataFrame:
    """Sum and count per entity, window and metric, before any fan-out."""
    parts = []
    for m in METRICS:
        parts += [F.sum(_of_type(m)).alias(f"sum_{m}"), F.count(_of_type(m)).alias(f"n_{m}")]
    return (
        route(readings, ("invernadero", "planta"))
        .groupBy(F.window("event_time", every).alias("w"), "entity_type", "entity_id")
        .agg(*parts)
    )


def fanout_targets(members: DataFrame) -> DataFrame:
    """The entities a plant takes readings from: itself and its greenhouse, if that exists."""
    own = F.struct(F.lit("planta").alias("entity_type"), F.col("plant_id").alias("entity_id"))
    house = F.struct(F.lit("invernadero").alias("entity_type"), F.col("greenhouse_id").alias("entity_id"))
    sources = F.when(F.col("has_greenhouse"), F.array(own, house)).otherwise(F.array(own))
    return members.select("plant_id", "greenhouse_id", "user_id", "tipo", "variedad", F.inline(sources))


def fanout_partials(partials: DataFrame, members: DataFrame, by_day: bool = False) -> DataFrame:
    """Greenhouse partials go to every plant inside, plant partials to their plant.

    Both ways share one join, so the readings are scanned and reduced once. With
    `by_day` the copies are dealt by day and plant, once, and the rows of a
    plant's day come out in one partition, ready to be written.
    """
    means = [
        (F.sum(f"sum_{m}") / F.nullif(F.sum(f"n_{m}"), F.lit(0))).alias(m) for m in METRICS
    ]
    copies = partials.withColumn("timestamp", F.col("w.start")).join(fanout_targets(members), ["entity_type", "entity_id"])
    keys = ["timestamp", "plant_id", "greenhouse_id", "user_id", "tipo", "variedad"]
    if by_day:
        # The day follows from the timestamp, so as a key it parts no group, and the groups need no shuffle of their own.
        copies = copies.withColumn("_day", F.to_date("timestamp")).repartition("_day", "plant_id", "greenhouse_id")
        keys = ["_day", *keys]
    per_plant = copies.groupBy(*keys).agg(*means)
    return per_plant.select(
        "user_id", "greenhouse_id", "plant_id", "timestamp", *METRICS,
        F.col("tipo").alias("tipo_cultivo"), "variedad", F.lit(None).cast("date").alias("fecha_plantacion"),
    )


def fanout_mean(readings: DataFrame, greenhouses: DataFrame, plants: DataFrame,
                every: str = "5 minutes") -> DataFrame:
    """One row per plant and window, averaging greenhouse and plant readings.

    Readings are reduced to one partial per entity and window first, so the
    rows copied to the plants do not grow with the number of readings.
    """
    return fanout_partials(window_partials(readings, every), plants_with_owner(plants, greenhouses))


# ---- device states --------------------------------------------------------

def active_sensors(sensors: DataFrame, connections: DataFrame) -> DataFrame:
    """Active registry rows with the address of their connection."""
    links = connections.select(F.col("id").alias("connection_id"), "ha_url")
    return sensors.filter("active").join(links, "connection_id").select(
        "connection_id", "ha_url", "sensor_id", "sensor_type",
        F.col("location_id").cast("string").alias("location_id"), "location_type",
        F.col("user_id").cast("string").alias("user_id"),
    )


def discover_sensors(states: DataFrame) -> DataFrame:
    """Devices that measure something known, under their registry sensor type."""
    rows = states.select(
        F.col("entity_id").alias("sensor_id"),
        F.coalesce("attributes.friendly_name", "entity_id").alias("display_name"),
        F.col("attributes.device_class").alias("sensor_type"),
        "state",
        F.col("attributes.unit_of_measurement").alias("unit"),
    )
    return map_vocabulary(rows, "sensor_type", DEVICE_CLASSES, keep_unknown=False)


def discover_switches(states: DataFrame) -> DataFrame:
    """Devices that can be switched."""
    return filter_domain(states, SWITCHABLE_DOMAINS).select(
        F.col("entity_id").alias("sensor_id"),
        F.coalesce("attributes.friendly_name", "entity_id").alias("display_name"),
        "state", "domain",
    )


def states_to_readings(states: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """Device states of registered sensors as readings taken at `as_of`.

    Without a connection_id in the states, entity ids are taken as unique.
    """
    on = [c for c in ("connection_id",) if c in states.columns]
    known = states.filter(~F.col("state").isin(*MISSING_STATES)).withColumn("valor", finite("state"))
    rows = registry.withColumn("entity_id", F.col("sensor_id")).join(
        known.filter(F.col("valor").isNotNull()), [*on, "entity_id"]
    )
    readings = rows.select(
        F.col("location_type").alias("entity_type"),
        F.col("location_id").alias("entity_id"),
        "user_id",
        F.col("sensor_type").alias("sensor_tipo"),
        "valor",
        F.col("attributes.unit_of_measurement").alias("unidad"),
        "sensor_id",
        as_of.alias("timestamp_lectura"),
    )
    return map_vocabulary(readings, "sensor_tipo")


def attach_registry(pushed: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pushed (sensor_id, value) rows with their active sensor, and the rejected ones.

    On a stream only the first result is used: the second needs a left join
    with a condition on the static side, which Spark supports as well.
    """
    active = registry.filter("active").select(
        "sensor_id", "sensor_type", F.col("location_id").alias("parcela_usuario_id"), "user_id",
        F.lit(True).alias("_known"),
    )
    complete = pushed.filter(F.col("sensor_id").isNotNull() & (F.col("sensor_id") != "") & F.col("value").isNotNull())
    joined = complete.join(active, "sensor_id", "left")
    ok = joined.filter("_known").drop("_known").withColumn("value", F.col("value").cast("string"))
    unknown = joined.filter(F.col("_known").isNull()).select(
        *pushed.columns, F.lit("sensor not registered or inactive").alias("reason")
    )
    partial = pushed.filter(
        F.col("sensor_id").isNull() | (F.col("sensor_id") == "") | F.col("value").isNull()
    ).select("*", F.lit("sensor_id and value are required").alias("reason"))
    return ok, unknown.unionByName(partial)
