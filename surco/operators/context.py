"""Questions over the readings of every entity at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ntz, since

RECENT = ("temperatura", "humedad_suelo", "humedad_ambiental")


def _hours_before(as_of, hours: int) -> Column:
    return ntz(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")


def rolling_stats(readings: DataFrame, as_of, hours: int, means: Sequence[str], sums: Sequence[str] = (),
                  guard: str | None = None, mode: str = "rows", key: str = "parcel_id",
                  time_col: str = "timestamp", round_to: int = 2) -> DataFrame:
    """Means and sums over the last hours; all null for a key whose `guard` mean is null.

    mode="rows" sums every row. mode="daily" counts a day's amount once, for
    tables whose rows repeat the amount of the whole day.
    """
    if mode not in ("rows", "daily"):
        raise ValueError("mode is 'rows' or 'daily'")
    recent = since(readings, time_col, _hours_before(as_of, hours))
    if mode == "daily":
        parts = recent.groupBy(key, F.to_date(time_col).alias("_day")).agg(
            *[F.sum(m).alias(f"_s_{m}") for m in means],
            *[F.count(m).alias(f"_n_{m}") for m in means],
            *[F.max(s).alias(s) for s in sums],
        )
        out = parts.groupBy(key).agg(
            *[(F.sum(f"_s_{m}") / F.nullif(F.sum(f"_n_{m}"), F.lit(0))).alias(f"{m}_media") for m in means],
            *[F.sum(s).alias(f"{s}_acumulado") for s in sums],
        )
    else:
        out = recent.groupBy(key).agg(
            *[F.avg(m).alias(f"{m}_media") for m in means],
            *[F.sum(s).alias(f"{s}_acumulado") for s in sums],
        )
    names = [f"{m}_media" for m in means] + [f"{s}_acumulado" for s in sums]
    shown = F.col(f"{guard}_media").isNotNull() if guard else F.lit(True)
    return out.select(key, *[F.when(shown, F.round(n, round_to)).alias(n) for n in names])


def stats_24h(readings: DataFrame, as_of, key: str = "parcel_id") -> DataFrame:
    return rolling_stats(readings, as_of, 24, RECENT, guard="temperatura", key=key)


def stats_7d(readings: DataFrame, as_of, key: str = "parcel_id", mode: str = "rows") -> DataFrame:
    return rolling_stats(
        readings, as_of, 168, ["temperatura"], ["precipitacion_mm", "et0"], "temperatura", mode, key=key
    )


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 5) -> DataFrame:
    """The newest n rows per key, with their place from 1 on.

    The limit on row_number is applied before the shuffle as well, so a key
    with very many rows sends at most n of them from each task.
    """
    newest = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("puesto", F.row_number().over(newest)).filter(F.col("puesto") <= n)


def last_actions(actions: DataFrame, n: int = 5, ties: Sequence[str] = ()) -> DataFrame:
    fields = actions.filter(F.col("entity_type") == "parcela").select(
        F.col("entity_id").alias("parcel_id"), F.col("tipo_evento").alias("tipo"),
        F.col("timestamp").alias("fecha"), F.col("valor").alias("detalle"), *ties,
    )
    return last_n(fields, ["parcel_id"], ["fecha", *ties], n)


def entity_context(readings: DataFrame, actions: DataFrame, as_of, n: int = 5,
                   ties: Sequence[str] = ()) -> DataFrame:
    """One record per entity: crop, last day, last week, last actions.

    Day, week and crop come from one scan and one aggregate of the readings.
    """
    day, week = _hours_before(as_of, 24), _hours_before(as_of, 168)

    def recent(column: str, lower: Column) -> Column:
        return F.when(F.col("timestamp") >= lower, F.col(column))

    stats = readings.groupBy("parcel_id").agg(
        F.max_by("tipo_cultivo", F.when(F.col("tipo_cultivo").isNotNull(), F.col("timestamp"))).alias("cultivo"),
        *[F.round(F.avg(recent(c, day)), 2).alias(f"d_{c}") for c in RECENT],
        F.round(F.avg(recent("temperatura", week)), 2).alias("w_temperatura"),
        F.round(F.sum(recent("precipitacion_mm", week)), 2).alias("w_precipitacion"),
        F.round(F.sum(recent("et0", week)), 2).alias("w_et0"),
    )
    has_day, has_week = F.col("d_temperatura").isNotNull(), F.col("w_temperatura").isNotNull()
    # At most n actions per entity are left to collect.
    done = (
        last_actions(actions, n, ties)
        .groupBy("parcel_id")
        .agg(F.array_sort(F.collect_list(F.struct("puesto", "tipo", "fecha", "detalle"))).alias("acciones_recientes"))
    )
    none = F.array().cast(done.schema["acciones_recientes"].dataType)
    return stats.join(done, "parcel_id", "left").select(
        "parcel_id",
        "cultivo",
        F.struct(
            F.col("d_temperatura").alias("temp_media"),
            F.when(has_day, F.col("d_humedad_suelo")).alias("humedad_suelo_media"),
            F.when(has_day, F.col("d_humedad_ambiental")).alias("humedad_ambiental_media"),
        ).alias("ultimas_24h"),
        F.struct(
            F.col("w_temperatura").alias("temp_media"),
            F.when(has_week, F.col("w_precipitacion")).alias("precipitacion_acumulada"),
            F.when(has_week, F.col("w_et0")).alias("et0_acumulado"),
        ).alias("ultimos_7d"),
        F.coalesce("acciones_recientes", none).alias("acciones_recientes"),
    )


def profile(df: DataFrame, key: str, day: str, values: Sequence[str], source: str | None = None,
            forecast: str = "forecast") -> DataFrame:
    """One row about a whole table: span, size, gaps, mean and spread."""
    parts = [
        F.min(day).alias("desde"), F.max(day).alias("hasta"), F.count(F.lit(1)).alias("filas"),
        F.count_distinct(key).alias("parcelas"),
    ]
    for v in values:
        parts += [
            F.sum(F.col(v).isNull().cast("bigint")).alias(f"nulos_{v}"),
            F.avg(v).alias(f"media_{v}"),
            F.stddev_samp(v).alias(f"desv_{v}"),
        ]
    if source:
        parts.append(F.sum((F.col(source) == forecast).cast("bigint")).alias("dias_forecast"))
    return df.agg(*parts)


def rows_by_source(df: DataFrame, source: str = "fuente") -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("filas"))


# ---- time spine and decaying response -------------------------------------

def time_spine(entities: DataFrame, start: str, steps: int, step: str = "1 hour", into: str = "ts") -> DataFrame:
    """Every entity at every step. Each entity row unfolds its own steps."""
    return entities.select("*", F.explode(_steps(ntz(start), steps, step)).alias(into))


# Exponent over a period, and periods after which e^(-FADE * KEPT) is zero in doubles.
FADE, KEPT = 50.0, 16


def decayed_response(entities: DataFrame, events: DataFrame, key: str, ts: str, amp: str, rate: float, start: str,
                     steps: int, step: str = "1 hour", base: Column | float = 0.0, low: float | None = None,
                     high: float | None = None, into: str = "respuesta") -> DataFrame:
    """At every step: base + sum of amp * exp(-rate * days since) over all earlier events, clamped.

    The sum obeys a recurrence, so events and steps are never paired. Events
    first move to the next step, decayed by the way there, and are added up
    per entity and step; what is left to order is bounded by the steps,
    however many events an entity has. Steps are cut into periods over which a
    response fades by e^-FADE at most: a running sum inside a period plus the
    decayed totals of the earlier ones, which keeps every exponent small. What
    is more than KEPT periods old is below the smallest number there is.
    """
    origin = ntz(start)
    width = (_epoch_seconds(origin + F.expr(f"INTERVAL '{step}'")) - _epoch_seconds(origin)).cast("double")
    per_step = width / 86400 * rate
    period = F.when(per_step > 0, F.greatest(F.lit(1), F.floor(FADE / F.nullif(per_step, F.lit(0.0))))).otherwise(steps)
    period = F.least(period, F.lit(steps)).cast("bigint")

    since_start = (_epoch_seconds(F.col(ts)) - _epoch_seconds(origin)) / width
    at = F.ceil(since_start).cast("bigint")
    arrived = F.col(amp).cast("double") * F.exp((since_start - at) * per_step)
    hits = events.filter(F.col(ts).isNotNull()).select(key, at.alias("_i"), arrived.alias("_a"))
    # What happened before the first step counts from there on.
    early = F.least(F.col("_i"), F.lit(0))
    hits = hits.filter(F.col("_i") < steps).select(
        key, F.greatest(F.col("_i"), F.lit(0)).cast("bigint").alias("_i"), (F.col("_a") * F.exp(early * per_step)).alias("_a")
    )
    hits = hits.groupBy(key, "_i").agg(F.sum("_a").alias("_a"))
    spine = entities.select("*", F.posexplode(_steps(origin, steps, step)).alias("_i", "ts"))
    spine = spine.select(key, F.col("_i").cast("bigint").alias("_i"), F.struct(*entities.columns, "ts").alias("_row"))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("_p", F.floor(F.col("_i") / period).cast("bigint"))

    inside = F.col("_i") - F.col("_p") * period
    raised = placed(hits).withColumn("_up", F.col("_a") * F.exp(inside * per_step)).drop("_a")
    both = raised.unionByName(placed(spine), allowMissingColumns=True)
    running = W.partitionBy(key, "_p").orderBy("_i").rangeBetween(W.unboundedPreceding, W.currentRow)
    local = both.withColumn("_sum", F.coalesce(F.sum("_up").over(running), F.lit(0.0))).filter(F.col("_row").isNotNull())

    # What a period leaves at the start of each of the next ones.
    totals = raised.groupBy(key, "_p").agg((F.sum("_up") * F.exp(per_step * -period)).alias("t"))
    last = F.floor(F.lit(steps - 1) / period).cast("bigint")
    later = F.filter(F.sequence(F.col("_p") + 1, F.col("_p") + KEPT), lambda q: q <= last)
    carried = totals.select(key, "_p", "t", F.explode(later).alias("_q"))
    left = F.col("t") * F.exp((F.col("_q") - F.col("_p") - 1) * per_step * -period)
    carried = carried.groupBy(key, F.col("_q").alias("_p")).agg(F.sum(left).alias("_carry"))
    value = base if isinstance(base, Column) else F.lit(float(base))
    total = (F.col("_sum") + F.coalesce("_carry", F.lit(0.0))) * F.exp(inside * -per_step) + value
    if low is not None:
        total = F.greatest(F.lit(float(low)), total)
    if high is not None:
        total = F.least(F.lit(float(high)), total)
    return local.join(carried, [key, "_p"], "left").select("_row.*", total.alias(into))


def _steps(first: Column, steps: int, step: str) -> Column:
    size = F.expr(f"INTERVAL '{step}'")
    return F.sequence(first, first + size * F.lit(steps - 1), size)


def _epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")
    return F.unix_date(F.to_date(ts)) * 86400 + clock
