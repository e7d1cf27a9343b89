"""Alerts when two linked parties, or a party and a safe zone, come close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import compass_sector, geodesic_m, haversine_m
from ..functions.columns import nth_number
from ..functions.fixed_values import DEFAULT_SAFETY_M
from ..sources.schemas import ALERTS
from .tables import last_by_role, merge_latest

# The sphere and the ellipsoid differ by less than 0.6 %.
MARGIN = 1.01


def link_positions(victims: DataFrame, relations: DataFrame) -> DataFrame:
    """Victim positions once per linked aggressor; unlinked victims drop out."""
    links = relations.select(
        F.trim(F.col("id_victima").cast("string")).alias("user_id"),
        F.trim(F.col("id_agresor").cast("string")).alias("id_agresor"),
        F.coalesce(F.col("dist_seguridad").cast("double"), F.lit(DEFAULT_SAFETY_M)).alias("dist_seguridad"),
    )
    return victims.join(links, "user_id")


def _distance(cases: DataFrame, metric: str, limit: Column) -> DataFrame:
    """Rows that can be within the limit, with their distance in `_m`.

    The cheap spherical test runs first, inside the JVM, with a margin wide
    enough to lose nothing; only what passes reaches the ellipsoid.
    """
    points = [F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")]
    sphere = haversine_m(*points)
    if metric == "haversine":
        return cases.withColumn("_m", sphere)
    close = cases.filter(sphere <= limit * MARGIN + 1)
    return close.withColumn("_m", geodesic_m(*points))


def proximity_alerts(positions: DataFrame, relations: DataFrame, zones: DataFrame,
                     every: str = "15 seconds", metric: str = "geodesic") -> DataFrame:
    """Alert rows of both kinds in one layout.

    Positions bring user_id, tipo (victima or agresor), coordinates, lat, lon,
    timestamp, event_time and message_id. The last position of an aggressor in
    a window stands for it, so a window never pairs all with all.
    """
    if metric not in ("geodesic", "haversine"):
        raise ValueError("metric is 'geodesic' or 'haversine'")
    placed = positions.withColumn("w", F.window("event_time", every)["start"])
    aggressors = last_by_role(
        placed, ["user_id", "w"], "tipo", "agresor", ["coordinates", "lat", "lon", "timestamp"],
        ["event_time", "message_id"],
    ).select(
        F.col("user_id").alias("id_agresor"), "w", F.col("coordinates").alias("coordenadas_agresor"),
        F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.col("timestamp").alias("a_ts"),
    )
    victims = placed.filter(F.col("tipo") == "victima").select(
        "user_id", "w", "message_id", F.col("coordinates").alias("coordenadas_victima"),
        F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"),
    )
    met = link_positions(victims, relations).join(aggressors, ["id_agresor", "w"])

    # Every linked victim meets its aggressor itself, and once per zone of its own.
    places = zones.select(
        F.trim(F.col("id_victima").cast("string")).alias("user_id"), "id_place",
        F.col("place_name").alias("nombre_place"), F.col("place_coordinates").alias("coordenadas_place"),
        F.col("radius").alias("radio_zona"),
        nth_number("place_coordinates", 0).alias("z_lat"), nth_number("place_coordinates", 1).alias("z_lon"),
        F.lit("place").alias("alerta"),
    )
    itself = relations.select(
        F.trim(F.col("id_victima").cast("string")).alias("user_id"), F.lit("fisica").alias("alerta")
    ).distinct()
    cases = met.join(places.unionByName(itself, allowMissingColumns=True), "user_id")
    physical = F.col("alerta") == "fisica"
    cases = cases.withColumn("b_lat", F.when(physical, F.col("v_lat")).otherwise(F.col("z_lat"))).withColumn(
        "b_lon", F.when(physical, F.col("v_lon")).otherwise(F.col("z_lon"))
    )
    limit = F.when(physical, F.col("dist_seguridad")).otherwise(F.col("dist_seguridad") + F.col("radio_zona"))
    metres = F.round("_m", 2)
    # The rounded distance is compared between parties, the exact one for zones.
    alerts = _distance(cases, metric, limit).filter(F.when(physical, metres).otherwise(F.col("_m")) < limit).select(
        "alerta",
        F.lit(True).alias("activa"),
        F.col("user_id").alias("id_victima"),
        "id_agresor",
        metres.alias("distancia_metros"),
        compass_sector(F.col("a_lat") - F.col("b_lat"), F.col("a_lon") - F.col("b_lon")).alias("direccion_escape"),
        "coordenadas_agresor",
        F.when(physical, F.col("coordenadas_victima")).alias("coordenadas_victima"),
        "coordenadas_place",
        F.col("a_ts").alias("timestamp"),
        "dist_seguridad", "id_place", "nombre_place", "radio_zona",
    )
    layout = [part.split()[:2] for part in ALERTS.split(", ")]
    return alerts.select(
        *[(F.col(n) if n in alerts.columns else F.lit(None)).cast(kind).alias(n) for n, kind in layout]
    )


def alert_key() -> Column:
    """Key of the alert document: the place or the victim, and the aggressor."""
    who = F.when(F.col("alerta") == "place", F.col("id_place")).otherwise(F.col("id_victima"))
    return F.concat_ws("_", who, "id_agresor")


def alert_state(current: DataFrame | None, alerts: DataFrame, order: list[str]) -> DataFrame:
    """Latest alert document per key; fields a new alert lacks stay as they were."""
    columns = [c for c in alerts.columns if c not in ("doc_id", *order)]
    keyed = alerts.withColumn("doc_id", alert_key())
    update = [c for c in [*columns, *order] if c != "doc_id"]
    return merge_latest(current, keyed, ["doc_id"], list(dict.fromkeys(update)), order, skip_nulls=True)
