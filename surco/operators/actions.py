"""Farmer actions: validation, time stamps and the last action of every field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ntz
from ..functions.fixed_values import ACTION_FIELDS
from .tables import merge_latest

ISO_WALL_CLOCK = r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?)(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?$"


def action_time(day: Column, instant: Column, as_of) -> Column:
    """Noon of the day, else the wall clock of the instant without its offset, else now.

    Null where the text given cannot be read.
    """
    has_day = F.coalesce(day != "", F.lit(False))
    has_instant = F.coalesce(instant != "", F.lit(False))
    noon = F.when(
        day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat(day, F.lit(" 12:00:00")).try_cast("timestamp_ntz")
    )
    wall = F.nullif(F.regexp_extract(instant, ISO_WALL_CLOCK, 1), F.lit("")).try_cast("timestamp_ntz")
    return F.when(has_day, noon).when(has_instant, wall).otherwise(F.date_trunc("second", ntz(as_of)).cast("timestamp_ntz"))


def validate_actions(requests: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(actions, rejected requests with the reason).

    Requests bring user_id, entity_type, entity_id, tipo_evento, valor, fecha
    and timestamp, all as text; other columns are carried along.
    """
    extra = [
        c for c in requests.columns
        if c not in ("user_id", "entity_type", "entity_id", "tipo_evento", "valor", "fecha", "timestamp")
    ]
    missing = F.lit(False)
    for c in ("user_id", "entity_id", "tipo_evento"):
        missing = missing | F.col(c).isNull() | (F.col(c) == "")
    when = action_time(F.col("fecha"), F.col("timestamp"), as_of)
    reason = (
        F.when(missing, F.lit("user_id, entity_id and tipo_evento are required"))
        .when(~F.col("tipo_evento").isin(*ACTION_FIELDS), F.lit("unknown tipo_evento"))
        .when(F.col("_ts").isNull(), F.lit("unreadable date"))
    )
    checked = requests.withColumn("_ts", when).withColumn("reason", reason)
    valid = checked.filter(F.col("reason").isNull()).select(
        "user_id",
        F.coalesce("entity_type", F.lit("parcela")).alias("entity_type"),
        "entity_id",
        F.col("_ts").alias("timestamp"),
        "tipo_evento", "valor", *extra,
    )
    rejected = checked.filter(F.col("reason").isNotNull()).drop("_ts")
    return valid, rejected


def last_action_state(current: DataFrame | None, actions: DataFrame, order_by: str = "event",
                      arrival: str = "message_id") -> DataFrame:
    """Per field: time of the last action of each kind and the last fertiliser.

    order_by="event" keeps the latest action by its own time, however the log is
    cut into calls; "arrival" lets every new action overwrite the state, as it
    comes in. `abono_orden` is the place of the named fertiliser in that order.
    """
    fields = actions.filter(F.col("entity_type") == "parcela")
    by_event = order_by == "event"
    place = F.struct(F.col("timestamp"), F.col(arrival).alias("llegada"))
    order = place if by_event else F.struct(arrival)
    kinds = [
        F.max_by("timestamp", F.when(F.col("tipo_evento") == kind, order)).alias(field)
        for kind, field in ACTION_FIELDS.items()
    ]
    named = F.when((F.col("tipo_evento") == "abonado") & (F.col("valor") != ""), order)
    new = fields.groupBy("user_id", "entity_id").agg(
        *kinds, F.max_by("valor", named).alias("tipo_abono"), F.max_by(place, named).alias("abono_orden"),
    )
    if current is None:
        return new
    keys, state = ["user_id", "entity_id"], [*ACTION_FIELDS.values(), "tipo_abono", "abono_orden"]
    if not by_event:
        return merge_latest(current, new.withColumn("_o", F.lit(1)), keys, state, ["_o"], skip_nulls=True)
    both = new.unionByName(current.select(*keys, *state))
    return both.groupBy(*keys).agg(
        *[F.max(f).alias(f) for f in ACTION_FIELDS.values()],
        F.max_by("tipo_abono", "abono_orden").alias("tipo_abono"), F.max("abono_orden").alias("abono_orden"),
    )
