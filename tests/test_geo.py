"""Projection, polygons, distances and alerts on small cases."""

import json
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from surco.functions import geodesy as g
from surco.functions.fixed_values import COMPASS
from surco.operators import geometry as gm, proximity as px
from surco.plans import geo
from surco.sources.messages import with_lat_lon


def test_projection_there_and_back(spark):
    df = spark.createDataFrame([(39.47, -0.376), (-33.9, 151.2), (0.0, 0.0)], "lat double, lng double")
    x, y = g.to_mercator("lat", "lng")
    out = df.withColumn("x", x).withColumn("y", y)
    lat, lng = g.from_mercator(F.col("x"), F.col("y"))
    for r in out.select("lat", "lng", lat.alias("a"), lng.alias("b")).collect():
        assert (r.a, r.b) == (pytest.approx(r.lat, abs=1e-9), pytest.approx(r.lng, abs=1e-9))


def test_tile_rows_count_from_the_south(spark):
    df = spark.createDataFrame([(39.47, -0.376)], "lat double, lng double")
    tx, ty = g.tile_key("lat", "lng", 15)
    n = 2**15
    r = math.radians(39.47)
    north = int((1 - math.log(math.tan(r) + 1 / math.cos(r)) / math.pi) / 2 * n)
    assert tuple(df.select(tx, ty).first()) == (int((-0.376 + 180) / 360 * n), n - 1 - north)


def test_sectors_every_quarter_degree(spark):
    df = spark.range(0, 1440).select((F.col("id") / 4).alias("deg"))
    out = df.select("deg", g.compass_sector(F.sin(F.radians("deg")), F.cos(F.radians("deg"))).alias("s")).collect()
    for r in out:
        if (r.deg + 22.5) % 45 == 0:
            continue  # sine and cosine are not exact on the borders
        assert r.s == COMPASS[int(((r.deg + 22.5) % 360) // 45)]


@pytest.mark.parametrize("a,b,metres", [
    ((0.0, 0.0), (0.0, 1.0), 111319.4908),
    ((0.0, 0.0), (1.0, 0.0), 110574.3886),
    ((50.0, 5.0), (50.0, 5.0), 0.0),
    ((-37.95103342, 144.42486789), (-37.65282114, 143.92649553), 54972.271),
])
def test_ellipsoid_distance(spark, a, b, metres):
    df = spark.createDataFrame([(*a, *b)], "a double, b double, c double, d double")
    got = df.select(g.geodesic_m("a", "b", "c", "d"), g.haversine_m(*[F.col(c) for c in "abcd"])).first()
    assert got[0] == pytest.approx(metres, abs=2e-3)
    assert got[1] == pytest.approx(metres, rel=6e-3)


def feature(n, *rings, multi=False):
    body = {"type": "MultiPolygon", "coordinates": [[r] for r in rings]} if multi else {"type": "Polygon", "coordinates": list(rings)}
    return (n, json.dumps(body))


def square(x, y, side):
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]


def test_points_find_their_polygon(spark):
    shapes = gm.parse_geometry(spark.createDataFrame([
        feature(2, square(0, 0, 100), square(40, 40, 20)),      # the hole does not count
        feature(1, square(50, 50, 100)),                        # overlaps, lower id
        feature(3, square(5000, 5000, 40), square(6000, 6000, 40), multi=True),
        feature(4, square(-30000, -30000, 20000)),              # over many tiles
    ], "feature_id int, geometry string"))
    spots = [(1, 50.0, 45.0), (2, 60.0, 60.0), (3, 6020.0, 6020.0), (4, -15000.0, -15000.0), (5, 300.0, 300.0), (6, 5500.0, 5500.0)]
    df = spark.createDataFrame(spots, "point_id int, x double, y double")
    lat, lng = g.from_mercator(F.col("x"), F.col("y"))
    points = df.select("point_id", lat.alias("lat"), lng.alias("lng"))
    for zoom in (9, 12, 15):
        assert rows(gm.points_in_polygons(points, shapes, zoom)) == [(1, 2), (2, 1), (3, 3), (4, 4)]


def test_a_polygon_of_any_size_stands_in_four_tiles_at_most(spark):
    """From a point to half the world; every point of a box finds its polygon, whatever sizes stand beside it."""
    sides = [0, 1, 100, 111_320, 3_000_000, 20_000_000]
    shapes = gm.parse_geometry(spark.createDataFrame(
        [feature(i, square(-1_234_567.0 + 17 * i, 765_432.0, side)) for i, side in enumerate(sides)], "feature_id int, geometry string"))
    tiles = gm.covering(shapes)
    counts = {r.feature_id: r["count"] for r in tiles.groupBy("feature_id").count().collect()}
    assert set(counts) == set(range(len(sides))) and max(counts.values()) <= 4
    zooms = {r.feature_id: r.zoom for r in tiles.collect()}
    assert zooms[5] < zooms[4] < zooms[3] < zooms[2] <= zooms[1] <= 20
    rng = random.Random(4)
    spots = [(n, -1_234_567.0 + rng.uniform(-0.2, 1.2) * side, 765_432.0 + rng.uniform(-0.2, 1.2) * side) for n, side in enumerate(sides * 40)]
    df = spark.createDataFrame(spots, "point_id int, x double, y double")
    lat, lng = g.from_mercator(F.col("x"), F.col("y"))
    got = dict(rows(gm.points_in_polygons(df.select("point_id", lat.alias("lat"), lng.alias("lng")), shapes)))
    want = {}
    for n, x, y in spots:
        inside = [i for i, side in enumerate(sides) if plain_inside(x, y, square(-1_234_567.0 + 17 * i, 765_432.0, side))]
        if inside:
            want[n] = inside[0]
    assert got == want and len(set(want.values())) >= 4


def plain_inside(x, y, ring):
    inside = False
    for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]]):
        if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
            inside = not inside
    return inside


def test_even_odd_on_and_around_the_border(spark):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [2.0, 1.0], [0.0, 4.0], [0.0, 0.0]]
    spots = [(i / 2, j / 2) for i in range(-1, 10) for j in range(-1, 10)]
    df = spark.createDataFrame([(x, y, ring) for x, y in spots], "x double, y double, r array<array<double>>")
    for row in df.select("x", "y", gm.point_in_ring(F.col("x"), F.col("y"), F.col("r")).alias("hit")).collect():
        assert row.hit == plain_inside(row.x, row.y, ring)


# ---- alerts ---------------------------------------------------------------

def positions(spark, *data):
    schema = "user_id string, tipo string, coordinates string, timestamp string, event_time timestamp_ntz, message_id int"
    return with_lat_lon(spark.createDataFrame(list(data), schema))


def moment(second):
    return datetime(2024, 1, 1, 0, 0, second)


def test_alerts(spark):
    pos = positions(
        spark,
        ("v", "victima", "39.0,-0.300", "t1", moment(1), 1),
        ("v", "victima", "39.0,-0.301", "t2", moment(2), 2),
        ("a", "agresor", "39.9,-0.300", "t0", moment(0), 3),     # an earlier position does not count
        ("a", "agresor", "39.001,-0.300", "t3", moment(3), 4),
        ("a", "agresor", "39.001,-0.300", "t9", moment(15), 5),  # the next window has no victim
        ("w", "victima", "39.0,-0.300", "t1", moment(1), 6),     # not linked
        ("v", "victima", "bad", "t1", moment(1), 7),
    )
    links = spark.createDataFrame([(" v", "a ", 120.0), ("v", "b", None)], "id_victima string, id_agresor string, dist_seguridad double")
    zones = spark.createDataFrame([("v", "7", "casa", "39.002,-0.300", 10.0), ("w", "8", "x", "39.001,-0.300", 10.0)],
                                  "id_victima string, id_place string, place_name string, place_coordinates string, radius double")
    out = px.proximity_alerts(pos, links, zones)
    got = rows(out, "alerta", "id_victima", "id_agresor", "direccion_escape", "timestamp", "id_place", "coordenadas_victima")
    assert got == [
        ("fisica", "v", "a", "Norte", "t3", None, "39.0,-0.300"),
        ("place", "v", "a", "Sur", "t3", "7", None),
        ("place", "v", "a", "Sur", "t3", "7", None),
    ]
    metres = out.filter("alerta = 'fisica'").first().distancia_metros
    assert metres == 111.02 and len(out.columns) == 16
    # At the limit itself there is no alert: the rounded distance must be less.
    exact = links.withColumn("dist_seguridad", F.lit(111.02))
    assert px.proximity_alerts(pos, exact, zones).filter("alerta = 'fisica'").count() == 0
    state = px.alert_state(None, out, ["timestamp"])
    assert rows(state, "doc_id") == [("7_a",), ("v_a",)]


def test_prefilter_loses_nothing(spark):
    df = spark.range(3000).select(
        (F.rand(1) * 160 - 80).alias("a"), (F.rand(2) * 300 - 150).alias("b"), F.rand(3).alias("c"), F.rand(4).alias("d")
    ).select("a", "b", (F.col("a") + F.col("c") / 100).alias("c"), (F.col("b") + F.col("d") / 100).alias("d"))
    out = df.select(g.geodesic_m("a", "b", "c", "d").alias("e"), g.haversine_m(*[F.col(x) for x in "abcd"]).alias("s"))
    assert out.filter(F.col("s") > F.col("e") * px.MARGIN + 1).count() == 0


def test_every_supplier_can_be_a_place_and_every_user_an_aggressor(spark, smallest):
    places = {r[0] for r in geo.zones(spark, smallest).select("id_place").distinct().collect()}
    assert places == {str(r[0]) for r in spark.read.parquet(f"{smallest}/supplier.parquet").select("s_suppkey").collect()}
    aggressors = {int(r[0]) for r in geo.relations(spark, smallest).select("id_agresor").distinct().collect()}
    assert aggressors == {r[0] for r in spark.read.parquet(f"{smallest}/events.parquet").select("user_id").distinct().collect()}
