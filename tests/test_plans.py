"""Shapes of the physical plans, and operators under a hot key."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from surco.operators import context as cx, documents as dc, geometry as gm, proximity as px, readings as rd, tables as tb
from surco.plans import load_all, roles
from surco.plans.registry import QUERIES
from surco.sources.tables import load

load_all()


def plan(df):
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan ==") :]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_needs_a_broadcast_or_a_cross_join(spark, smallest, no_broadcast, name):
    text = plan(QUERIES[name](spark, smallest))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "BroadcastExchange" not in text, "a side is forced to broadcast whatever its size"


def test_the_limit_per_key_runs_before_the_shuffle(spark, smallest):
    for name in ("last_actions_top5", "entity_context", "cosine_topk_by_crop"):
        assert re.search(r"WindowGroupLimit .*Partial", plan(QUERIES[name](spark, smallest))), name


def test_single_query_search_keeps_k_rows_per_task(spark, smallest):
    chunks = load(spark, smallest, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    text = plan(dc.cosine_topk(chunks, [0.1] * 64, 3))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_filters_and_columns_reach_the_scan(spark, smallest):
    text = plan(QUERIES["last_actions_top5"](spark, smallest))
    assert "EqualTo(event_type,signup)" in text
    text = plan(QUERIES["stats_24h"](spark, smallest))
    assert "GreaterThanOrEqual(ts," in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text


def test_windowed_means_take_one_shuffle(spark, smallest):
    for df in (rd.sensor_pivot(roles.readings(spark, smallest)), rd.window_partials(roles.house_readings(spark, smallest))):
        assert plan(df).count("Exchange hashpartitioning") == 1


def test_json_is_parsed_once_per_message(spark, smallest):
    assert plan(QUERIES["message_quarantine"](spark, smallest)).count("from_json(") == 1


def test_context_scans_the_readings_once(spark, smallest):
    text = plan(QUERIES["entity_context"](spark, smallest))
    assert text.count("FileScan") == 2  # readings, actions


def test_distance_is_measured_once(spark, smallest):
    assert plan(QUERIES["proximity_alerts"](spark, smallest)).count("ArrowEvalPython") == 1


# ---- a third of the rows under one key -------------------------------------

def hot(spark, n=30000):
    """Row ids with key 'hot' for a third and many keys for the rest."""
    return spark.range(n).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 500).cast("string")))


@pytest.fixture
def tiny_partitions(spark):
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key in changed:
        spark.conf.unset(key)


def test_hot_readings_shrink_before_the_shuffle(spark):
    df = hot(spark).select(
        F.lit("parcela").alias("entity_type"), F.col("k").alias("entity_id"), F.lit("u").alias("user_id"),
        F.lit("temperatura").alias("sensor_tipo"), F.col("id").cast("double").alias("valor"), F.lit("s").alias("sensor_id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("event_time"), F.col("id").alias("message_id"),
    ).repartition(8)
    out = rd.sensor_pivot(df)
    got = {r.entity_id: r.temperatura for r in out.collect()}
    assert got["hot"] == pytest.approx(sum(range(0, 30000, 3)) / 10000)
    final = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in final


def test_hot_key_of_a_join_is_split(spark, tiny_partitions):
    rows_df = hot(spark).withColumn("text", F.sha2(F.col("id").cast("string"), 256))
    dim = rows_df.select("k").distinct().withColumn("name", F.concat(F.lit("n"), "k"))
    out = rd.enrich(rows_df, dim, "k")
    out.write.format("noop").mode("overwrite").save()
    assert out.count() == 30000
    got = out.filter("k = 'hot'").agg(F.count(F.lit(1)), F.min("name"), F.max("name")).first()
    assert tuple(got) == (10000, "nhot", "nhot")


def test_hot_key_of_an_insert(spark, tiny_partitions):
    new = hot(spark)
    stored = spark.createDataFrame([("1",), ("2",)], "k string")
    ok, bad = tb.insert_if_absent(stored, new, ["k"], ["id"])
    keys = new.select("k").distinct().count()
    assert ok.count() == keys - 2 and ok.count() + bad.count() == 30000
    assert ok.filter("k = 'hot'").first().id == 0


def test_hot_key_of_latest_rows(spark):
    out = tb.keep_last(hot(spark).withColumn("t", F.col("id") % 1000), ["k"], ["t", "id"])
    best = out.filter("k = 'hot'").first()
    assert (best.t, best.id) == (999, 29999 - (29999 - 999) % 1000) or best.t == 999
    assert out.count() == hot(spark).select("k").distinct().count()


def test_hot_key_of_last_n(spark):
    out = cx.last_n(hot(spark), ["k"], ["id"], 5)
    assert [r.id for r in out.filter("k = 'hot'").orderBy("puesto").collect()] == [29997, 29994, 29991, 29988, 29985]


def test_hot_entity_of_the_decaying_response(spark):
    events = hot(spark).select(
        "k", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("t"), F.lit(1.0).alias("amp")
    )
    entities = spark.createDataFrame([("hot",)], "k string")
    out = cx.decayed_response(entities, events, "k", "t", "amp", 1.0, "2024-01-01", 10)
    last = out.orderBy(F.col("ts").desc()).first().respuesta
    import math

    want = sum(math.exp(-(9 * 3600 - s) / 86400) for s in range(0, 30000, 3))
    assert last == pytest.approx(want, rel=1e-9)


def test_hot_tile_of_the_point_lookup(spark, tiny_partitions):
    from surco.functions.geodesy import from_mercator

    spots = hot(spark, 6000).withColumn("x", F.when(F.col("k") == "hot", F.lit(50.0)).otherwise(F.col("id") * 100.0))
    lat, lng = from_mercator(F.col("x"), F.lit(50.0))
    points = spots.select(F.col("id").alias("point_id"), lat.alias("lat"), lng.alias("lng"))
    shapes = spark.createDataFrame([(1, '{"type":"Polygon","coordinates":[[[0,0],[100,0],[100,100],[0,100],[0,0]]]}')], "feature_id int, geometry string")
    out = gm.points_in_polygons(points, gm.parse_geometry(shapes), 15)
    assert out.count() == 2000


def test_hot_pair_of_parties(spark, tiny_partitions):
    n = 3000
    at = F.lit("2024-01-01 00:00:01").cast("timestamp_ntz")
    victims = spark.range(n).select(
        F.lit("v").alias("user_id"), F.lit("victima").alias("tipo"), F.lit("39.0,-0.3").alias("coordinates"), F.lit(39.0).alias("lat"),
        F.lit(-0.3).alias("lon"), F.col("id").cast("string").alias("timestamp"), at.alias("event_time"), "id",
    )
    others = victims.withColumn("user_id", F.lit("a")).withColumn("tipo", F.lit("agresor"))
    pos = victims.union(others).withColumnRenamed("id", "message_id")
    links = spark.createDataFrame([("v", "a", 10.0)], "id_victima string, id_agresor string, dist_seguridad double")
    zones = spark.createDataFrame([], "id_victima string, id_place string, place_name string, place_coordinates string, radius double")
    out = px.proximity_alerts(pos, links, zones)
    # One alert per victim position, not one per pair of positions.
    assert out.count() == n and rows(out.select("distancia_metros").distinct()) == [(0.0,)]
