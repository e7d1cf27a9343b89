"""Members of a key, one row each.

A key may have any number of members, so nothing here collects them into one
record; a writer that needs nested documents groups the rows that it fetches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import METRICS
from .tables import keep_last


def sensors_by_connection(readings: DataFrame) -> DataFrame:
    """The sensors to ask for over every connection."""
    return readings.select("connection_id", "ha_url", "sensor_id", "sensor_type", "location_id", "location_type", "user_id")


def relations_by_victim(relations: DataFrame, zones: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Aggressors with their safety distance, and zones, of every victim.

    `clase` tells them apart, `id_miembro` names the aggressor or the zone. Of a
    pair that is there more than once the last by `order` counts, if given.
    """
    pair = ["id_victima", "id_agresor"]
    near = keep_last(relations, pair, order) if order else relations
    near = near.select("id_victima", F.lit("agresor").alias("clase"), F.col("id_agresor").alias("id_miembro"), "dist_seguridad")
    places = zones.select("id_victima", F.lit("zona").alias("clase"), F.col("id_place").alias("id_miembro"),
                          "place_name", "place_coordinates", "radius")
    return near.unionByName(places, allowMissingColumns=True)


def plant_snapshot(state: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Latest values of every greenhouse (plant_id null) and of every plant, a column per metric.

    `state` is the long latest-value table: user_id, greenhouse_id, plant_id, sensor_tipo, valor.
    """
    values = [F.max(F.when(F.col("sensor_tipo") == m, F.col("valor"))).alias(m) for m in metrics]
    return state.groupBy("user_id", "greenhouse_id", "plant_id").agg(*values)


def parcel_lines(parcels: DataFrame, owner: str = "usuario_id") -> DataFrame:
    """A line per parcel of an owner, naming it, its crop and id; `?` where unknown."""
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("?"))

    line = F.concat(
        F.lit("- "), known("nombre"), F.lit(" ("), known("cultivo"), F.lit(") → ID: "), known("parcela_id")
    )
    return parcels.select(owner, line.alias("linea"))
