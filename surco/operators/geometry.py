"""Parcel polygons: properties, projection and the point lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import MERCATOR_HALF_M
from ..functions.geodesy import from_mercator_rings, tile_of_metres, to_mercator

# Names under which a cadastral property may come.
PROPERTY_NAMES = {
    "provincia": ("provincia", "prov", "PROVINCIA"),
    "municipio": ("municipio", "mun", "MUNICIPIO"),
    "agregado": ("agregado", "agr"),
    "zona": ("zona", "zon"),
    "poligono": ("poligono", "pol", "POLIGONO"),
    "parcela": ("parcela", "par", "PARCELA"),
}


def normalise_properties(df: DataFrame, properties: str = "properties", info: str | None = None) -> DataFrame:
    """Cadastral numbers, plot number, use and hectares out of JSON texts.

    `info` names the JSON column of the parcel service: its `id` list wins
    over the feature's own properties.
    """
    def of(column: str, path: str) -> Column:
        return F.get_json_object(column, path)

    columns = []
    for i, (name, variants) in enumerate(PROPERTY_NAMES.items()):
        sources = [of(info, f"$.id[{i}]")] if info else []
        sources += [of(properties, f"$.{v}") for v in variants]
        if name in ("agregado", "zona"):
            sources.append(F.lit("0"))
        columns.append(F.coalesce(*sources).try_cast("int").alias(name))
    if info:
        area = F.coalesce(of(info, "$.parcelaInfo.dn_surface").try_cast("double"), F.lit(0.0))
        columns += [
            F.coalesce(of(info, "$.query[0].recinto").try_cast("int"), F.lit(1)).alias("recinto"),
            F.round(area / 10000, 4).alias("superficie"),
            F.coalesce(of(info, "$.query[0].uso_sigpac"), F.lit("")).alias("uso_sigpac"),
        ]
    kept = [c for c in df.columns if c not in (properties, info)]
    return df.select(*kept, *columns)


def parse_geometry(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """GeoJSON Polygon and MultiPolygon as one shape: a list of polygons of rings of points."""
    kind = F.get_json_object(geometry, "$.type")
    coordinates = F.get_json_object(geometry, "$.coordinates")
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    polygons = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    return _once(df, polygons.alias("polygons")).drop(geometry)


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns by unfolding a one-element array, so that no later filter computes them again."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def polygons_to_degrees(polygons: Column) -> Column:
    return F.transform(polygons, from_mercator_rings)


def point_in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd rule over the edges of a ring of [x, y] points."""
    n = F.size(ring)
    before = F.concat(F.slice(ring, n, F.lit(1)), F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))))
    edges = F.zip_with(ring, before, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e):
        (xi, yi), (xj, yj) = [(e[k][0], e[k][1]) for k in ("a", "b")]
        at = F.try_divide((xj - xi) * (py - yi), yj - yi) + xi
        return F.when((yi > py) != (yj > py), px < at).otherwise(F.lit(False))

    return F.when(n > 0, F.size(F.filter(edges, crosses)) % 2 == 1).otherwise(F.lit(False))


def in_any_polygon(px: Column, py: Column, polygons: Column) -> Column:
    """Inside the outer ring of one of the polygons; holes do not count."""
    return F.exists(polygons, lambda rings: point_in_ring(px, py, rings[0]))


def _bounds(polygons: Column) -> list[Column]:
    outer = F.flatten(F.transform(polygons, lambda rings: rings[0]))
    xs, ys = F.transform(outer, lambda p: p[0]), F.transform(outer, lambda p: p[1])
    return [F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)]


def covering(polygons: DataFrame, zoom: int = 20, feature_id: str = "feature_id") -> DataFrame:
    """`feature_id, zoom, tx, ty` and the box: the four tiles at most that a polygon's box touches.

    The zoom of a polygon follows from its box: tiles as large as the longer side or up to twice that, `zoom` at most.
    """
    x0, x1, y0, y1 = _bounds(F.col("polygons"))
    boxed = _once(polygons, x0.alias("_x0"), x1.alias("_x1"), y0.alias("_y0"), y1.alias("_y1"))
    side = F.nullif(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")), F.lit(0.0))
    fits = F.coalesce(F.floor(F.log2(F.lit(2 * MERCATOR_HALF_M) / side)), F.lit(zoom))
    level = F.when(F.col("_x0").isNotNull(), F.greatest(F.lit(0), F.least(fits, F.lit(zoom))).cast("int"))
    sized = boxed.select(feature_id, "_x0", "_x1", "_y0", "_y1", level.alias("zoom"))
    tx0, ty0 = tile_of_metres(F.col("_x0"), F.col("_y0"), F.col("zoom"))
    tx1, ty1 = tile_of_metres(F.col("_x1"), F.col("_y1"), F.col("zoom"))
    return sized.withColumn("tx", F.explode(F.sequence(tx0, tx1))).withColumn("ty", F.explode(F.sequence(ty0, ty1)))


def points_in_polygons(points: DataFrame, polygons: DataFrame, zoom: int = 20, point_id: str = "point_id",
                       feature_id: str = "feature_id") -> DataFrame:
    """The polygon each point lies in; the lowest feature id wins a tie.

    Points bring lat and lng, polygons a `polygons` column in mercator metres.
    Polygons stand in tiles of their own size, four at most; a point looks up its
    tile at every zoom in use, `zoom` + 1 at most. Ids and boxes meet there; the
    geometry is fetched only for points within a box.
    """
    px, py = to_mercator("lat", "lng")
    spots = _once(points.select(point_id, "lat", "lng"), px.alias("_px"), py.alias("_py"))
    tiles = covering(polygons, zoom, feature_id)
    in_use = tiles.agg(F.collect_set("zoom")).scalar()
    spots = spots.withColumn("zoom", F.explode(in_use))
    tx, ty = tile_of_metres(F.col("_px"), F.col("_py"), F.col("zoom"))
    boxes = spots.withColumn("tx", tx).withColumn("ty", ty).join(tiles, ["zoom", "tx", "ty"]).filter(
        F.col("_px").between(F.col("_x0"), F.col("_x1")) & F.col("_py").between(F.col("_y0"), F.col("_y1"))
    )
    candidates = boxes.select(point_id, feature_id, "_px", "_py").join(polygons.select(feature_id, "polygons"), feature_id)
    hits = candidates.filter(in_any_polygon(F.col("_px"), F.col("_py"), F.col("polygons")))
    return hits.groupBy(point_id).agg(F.min(feature_id).alias(feature_id))
