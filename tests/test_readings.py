"""Windowed averages, baselines, plants and device states on small cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from surco.functions import columns as c
from surco.operators import readings as rd

SCHEMA = (
    "entity_type string, entity_id string, user_id string, sensor_tipo string, valor double, "
    "sensor_id string, event_time timestamp_ntz, message_id bigint"
)


def at(minute, second=0, hour=10):
    return datetime(2024, 1, 1, hour, minute, second)


def readings(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_hourly_pivot_means_first_user_and_empty_windows(spark):
    df = readings(spark, [
        ("parcela", "1", "late", "temperatura", 10.0, None, at(5), 2),
        ("parcela", "1", "early", "temperatura", 10.00005, None, at(5), 1),
        ("parcela", "1", "x", "humedad_suelo", None, None, at(6), 3),
        ("parcela", "2", "y", "otro", 5.0, None, at(7), 4),
        ("parcela", "1", "z", "humedad_ambiental", 50.0, None, at(0, hour=11), 5),
    ])
    out = rows(rd.sensor_pivot(df), "entity_id", "user_id", "temperatura", "humedad_ambiental", "humedad_suelo", "fuente_temperatura")
    assert out == [("1", "early", 10.0, None, None, "sensor"), ("1", "z", None, 50.0, None, None)]


def test_numbers_only(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("inf",), ("abc",), (None,), ("-2",)], "valor string")
    ok, bad = rd.drop_non_numeric(df)
    assert rows(ok) == [(-2.0,), (1.5,)]
    assert bad.count() == 4


def baseline(spark, data):
    schema = (
        "entity_id string, event_time timestamp_ntz, message_id bigint, user_id string, nombre string, "
        "temperatura double, humedad_ambiental double, precipitacion_mm double, et0 double, radiacion_solar double, "
        "cultivo string, variedad string, estado_cielo string"
    )
    return spark.createDataFrame(data, schema)


def test_baseline_covers_quiet_parcels_in_every_ticked_window(spark):
    parcels = spark.createDataFrame(
        [("1", "u", "n", 5.0, 60.0, 1.0, 2.0, 3.0, "olivo", "v", "Nublado"), ("2", "u", "n", None, None, None, None, None, None, None, None)],
        "entity_id string, user_id string, nombre string, temperatura double, humedad_ambiental double, precipitacion_mm double, et0 double, "
        "radiacion_solar double, cultivo string, variedad string, estado_cielo string")
    df = readings(spark, [
        ("parcela", "1", "u", "temperatura", 9.0, "", at(9), 3),
        ("parcela", "1", "u", "temperatura", 11.0, "s2", at(9, 30), 4),
        ("parcela", "1", "u", "humedad_suelo", 33.0, "s3", at(9, 40), 5),
        ("parcela", "1", "u", "temperatura", 99.0, "s4", at(10), 6),
        ("parcela", "3", "u", "temperatura", 1.0, "s", at(3), 7),
    ])
    ticks = df.filter("message_id IN (7)").select("event_time", "message_id")
    closed = rd.baseline_windows(df, ticks)
    out = rows(rd.override_baseline(closed.filter("NOT tick"), closed.filter("tick"), parcels), "parcel_id", "temperatura", "humedad_ambiental",
               "humedad_suelo", "fuente_temperatura", "sensor_id", "timestamp")
    assert out == [
        ("1", 10.0, 60.0, 33.0, "sensor", "s2", at(0)),
        ("2", None, None, None, "openmeteo", None, at(0)),
    ]


def test_spine_has_every_window_from_first_to_last_tick(spark):
    """Two ticks over two midnights: each window between them is there once per parcel, with or without sensors."""
    parcels = spark.createDataFrame([(str(i), "u", "n") for i in range(3)], "entity_id string, user_id string, nombre string")
    for c in ("temperatura", "humedad_ambiental", "precipitacion_mm", "et0", "radiacion_solar"):
        parcels = parcels.withColumn(c, F.lit(1.0))
    parcels = parcels.withColumns({c: F.lit("x") for c in ("cultivo", "variedad", "estado_cielo")})
    first, last = datetime(2024, 1, 1, 23, 20), datetime(2024, 1, 3, 0, 10)
    ticked = spark.createDataFrame([(first,), (last,)], "timestamp timestamp_ntz")
    heard = [("1", datetime(2024, 1, 2, 12, 0), "s", 5.0), ("1", datetime(2024, 1, 4), "late", 7.0), ("9", first, "unknown", 7.0)]
    sensors = spark.createDataFrame([(*h, None, None) for h in heard],
                                    "entity_id string, timestamp timestamp_ntz, sensor_id string, _temperatura double, _humedad_ambiental double, _humedad_suelo double")
    out = rows(rd.override_baseline(sensors, ticked, parcels), "parcel_id", "timestamp", "temperatura", "sensor_id")
    every = [first + timedelta(minutes=10) * i for i in range(150) if first + timedelta(minutes=10) * i <= last]
    want = [(str(i), t, 5.0 if (i, t.day, t.hour, t.minute) == (1, 2, 12, 0) else 1.0, "s" if (i, t.day, t.hour, t.minute) == (1, 2, 12, 0) else None)
            for i in range(3) for t in every]
    assert out == sorted(want, key=lambda r: tuple("" if v is None else str(v) for v in r)) and len(out) == 3 * 150 - 3 * (150 - len(every))
    assert rd.override_baseline(sensors, ticked.limit(0), parcels).count() == 0


def days_of(spark, sensors, last=datetime(2024, 1, 3, 0, 10)):
    """Parcel days of parcels with and without weather, one of them twice and one without id."""
    schema = ("entity_id string, user_id string, nombre string, temperatura double, humedad_ambiental double, precipitacion_mm double, et0 double, "
              "radiacion_solar double, cultivo string, variedad string, estado_cielo string")
    weather = (5.0, 60.0, None, 2.0, 3.0, "olivo", "v", "Nublado")
    parcels = spark.createDataFrame([("1", "u", "n", *weather), ("2", "u", "n", *[None] * 8), ("2", "u", "n", *[None] * 8), (None, "u", "n", *weather)], schema)
    heard = spark.createDataFrame(sensors, "entity_id string, timestamp timestamp_ntz, sensor_id string, _temperatura double, _humedad_ambiental double, _humedad_suelo double")
    ticked = spark.createDataFrame([(datetime(2024, 1, 1, 23, 20),), (last,)], "timestamp timestamp_ntz")
    return rd.baseline_days(heard, ticked, parcels)


HEARD = [("1", datetime(2024, 1, 2, 12), "s", 9.0, None, None), ("1", datetime(2024, 1, 2, 12), "t", 8.0, 1.0, None), ("1", datetime(2024, 1, 2, 23, 50), "s", None, None, 2.0),
         ("2", datetime(2024, 1, 2, 3), "a", 4.0, None, None), ("2", datetime(2024, 1, 2, 2), "b", 3.0, 7.0, None), ("2", datetime(2024, 1, 1, 23, 10), "early", 1.0, 1.0, 1.0),
         ("2", datetime(2024, 1, 2, 3, 5), "between", 1.0, 1.0, 1.0), (None, datetime(2024, 1, 2, 3), "nobody", 1.0, 1.0, 1.0)]


def test_unfolded_days_are_in_order_and_repeat_what_was_heard_twice(spark):
    out = rd.unfold_days(days_of(spark, HEARD).coalesce(1).sortWithinPartitions("_day", "entity_id")).collect()
    windows = 4 + 144 + 2
    assert len(out) == 4 * windows + 1
    assert [(r.parcel_id, r.timestamp) for r in out if r.parcel_id == "1"] == sorted((r.parcel_id, r.timestamp) for r in out if r.parcel_id == "1")
    noon = sorted((r.sensor_id, r.temperatura, r.humedad_ambiental) for r in out if r.parcel_id == "1" and r.timestamp == datetime(2024, 1, 2, 12))
    assert noon == [("s", 9.0, 60.0), ("t", 8.0, 1.0)]
    assert {(r.parcel_id, r.sensor_id) for r in out if r.sensor_id} == {("1", "s"), ("1", "t"), ("2", "a"), ("2", "b")}


def test_unfolding_sorts_no_windows_and_calls_no_function_per_window(spark):
    """Above the days a window is looked up in generated code; no array of windows is built row by row."""
    text = rd.unfold_days(days_of(spark, HEARD))._jdf.queryExecution().executedPlan().toString()
    above = text[:text.index("Generate posexplode")]
    assert "array_position" in above and "lambda" not in above and "Sort" not in above


def test_latest_values_need_few_windows_of_a_day(spark):
    """Heard windows and the last one of a day leave behind what all windows do."""
    from surco.operators.tables import merge_latest
    from surco.streaming.run import FIELD_STATE

    heard = [h for h in HEARD if h[2] != "t"]
    state = lambda df: rows(merge_latest(None, df, ["user_id", "parcel_id"], FIELD_STATE, ["timestamp"], skip_nulls=True))
    for last in (datetime(2024, 1, 3, 0, 10), datetime(2024, 1, 2, 23, 50), datetime(2024, 1, 2, 12), datetime(2024, 1, 2, 2, 50)):
        days = days_of(spark, heard, last)
        few = rd.unfold_days(days, latest=True)
        assert state(few) == state(rd.unfold_days(days))
        assert few.count() <= days.count() + 6


def test_fan_out_equals_plain_mean(spark):
    houses = spark.createDataFrame([(1, 7, "g1"), (2, 8, "empty")], "id int, usuario_id int, nombre string")
    plants = spark.createDataFrame(
        [(10, 1, "tomate", "a"), (11, 1, "pepino", "b"), (12, 9, "sin casa", "c")],
        "id int, invernadero_id int, tipo string, variedad string",
    )
    df = readings(spark, [
        ("invernadero", "1", "u", "temperatura", 20.0, None, at(0), 1),
        ("invernadero", "1", "u", "temperatura", 22.0, None, at(1), 2),
        ("planta", "10", "u", "temperatura", 30.0, None, at(2), 3),
        ("planta", "10", "u", "humedad_suelo", None, None, at(2), 4),
        ("invernadero", "2", "u", "temperatura", 1.0, None, at(2), 5),
        ("invernadero", "9", "u", "temperatura", 1.0, None, at(2), 6),
        ("planta", "12", "u", "otro", 1.0, None, at(2), 7),
        ("planta", "99", "u", "temperatura", 1.0, None, at(2), 8),
    ])
    out = rows(rd.fanout_mean(df, houses, plants), "plant_id", "greenhouse_id", "user_id", "temperatura", "humedad_suelo")
    assert out == [("10", "1", "7", 24.0, None), ("11", "1", "7", 21.0, None), ("12", "9", None, None, None)]


def test_fan_out_by_day_shuffles_the_copies_once(spark):
    """The same rows as without, also for repeated and null keys; behind the join one exchange, by day and plant."""
    houses = spark.createDataFrame([(1, 7, "g1"), (2, 8, "g2"), (2, 8, "g2"), (None, 9, "g")], "id int, usuario_id int, nombre string")
    plants = spark.createDataFrame(
        [(10, 1, "t", "a"), (11, 1, "t", "b"), (11, 1, "t", "b"), (12, 2, None, "c"), (None, 1, "t", "d"), (13, None, "t", None)],
        "id int, invernadero_id int, tipo string, variedad string",
    )
    data = [("planta" if i % 3 else "invernadero", str(10 + i % 4 if i % 3 else i % 4), "u", ("temperatura", "humedad_suelo")[i % 2], float(i), None,
             at(0) + timedelta(minutes=7 * i), i) for i in range(600)]
    partials, members = rd.window_partials(readings(spark, data)), rd.plants_with_owner(plants, houses)
    once = rd.fanout_partials(partials, members, by_day=True)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    got, want = (sorted(map(tuple, x.collect()), key=key) for x in (once, rd.fanout_partials(partials, members)))
    assert got == want and len({r[3].date() for r in got}) > 2
    above = [line for line in once._jdf.queryExecution().executedPlan().toString().split("Join")[0].splitlines() if "Exchange" in line]
    assert len(above) == 1 and "_day" in above[0]


def test_union_split_does_not_matter(spark):
    data = [("parcela", str(i % 3), "u", "temperatura", float(i), None, at(i % 60), i) for i in range(200)]
    whole = rd.sensor_pivot(readings(spark, data))
    halves = rd.sensor_pivot(readings(spark, data[150:]).union(readings(spark, data[:150])).repartition(7))
    assert rows(whole) == rows(halves)


def test_states_become_readings(spark):
    states = spark.createDataFrame(
        [("s1", "12.5", ("humidity", "x", "%")), ("s2", "unavailable", None), ("s3", "on", None), ("s4", "1", None)],
        "entity_id string, state string, attributes struct<device_class:string,friendly_name:string,unit_of_measurement:string>",
    )
    registry = spark.createDataFrame(
        [(1, "h", f"s{i}", t, str(i), "parcela", "u") for i, t in ((1, "ambient_humidity"), (2, "temperature"), (3, "temperature"), (5, "valve"))],
        "connection_id int, ha_url string, sensor_id string, sensor_type string, location_id string, location_type string, user_id string",
    )
    out = rd.states_to_readings(states, registry, c.ntz("2024-01-01 00:00:00"))
    assert rows(out, "entity_id", "sensor_tipo", "valor", "unidad") == [("1", "humedad_ambiental", 12.5, "%")]


def test_devices_are_discovered(spark):
    states = spark.createDataFrame(
        [("sensor.a", "1", ("moisture", None, "%")), ("switch.b", "on", (None, "Valve", None)), ("sensor.c", "2", ("power", "x", "W")), ("light", "on", None)],
        "entity_id string, state string, attributes struct<device_class:string,friendly_name:string,unit_of_measurement:string>",
    )
    assert rows(rd.discover_sensors(states)) == [("sensor.a", "sensor.a", "soil_moisture", "1", "%")]
    assert rows(rd.discover_switches(states)) == [("switch.b", "Valve", "on", "switch")]


def test_unknown_vocabulary_passes_or_drops(spark):
    df = spark.createDataFrame([("temperature",), ("ph",)], "sensor_tipo string")
    assert rows(rd.map_vocabulary(df, "sensor_tipo")) == [("ph",), ("temperatura",)]
    assert rows(rd.map_vocabulary(df, "sensor_tipo", keep_unknown=False)) == [("temperatura",)]


def test_domain_needs_a_dot(spark):
    df = spark.createDataFrame([("switch.a",), ("switch",), ("sensor.b",), ("valve.x.y",)], "entity_id string")
    assert rows(rd.filter_domain(df, ("switch", "valve"))) == [("switch.a", "switch"), ("valve.x.y", "valve")]


@pytest.mark.parametrize("province,municipality,code", [(46, 17, "46017"), (None, 5, "00005"), (3, None, "03000")])
def test_ine_code(spark, province, municipality, code):
    df = spark.createDataFrame([(province, municipality)], "p int, m int")
    assert df.select(c.ine_code("p", "m")).first()[0] == code


def test_sky_state_falls_back_to_code(spark):
    df = spark.createDataFrame([("Sol", 0), ("", 61), (None, 61), (None, 7), ("", None)], "d string, w int")
    got = [r[0] for r in df.select(c.sky_state("d", "w")).collect()]
    assert got == ["Sol", "Lluvia ligera", "Lluvia ligera", None, None]


def test_half_up_is_round_to_the_last_bit(spark):
    """Ties by their decimal text, their neighbours, zeros, what is no number and any magnitude."""
    import math
    import random

    random.seed(1)
    values = [0.0, -0.0, math.nan, math.inf, -math.inf, None, 5e-7, -5e-7, -4.9e-7, 0.1234565, 1.0000005, -1.0000005, 2.675, 1e300, 5e-324, 8589.9345915, 2.0**33]
    for _ in range(3000):
        tie = (random.randrange(-10**10, 10**10) + 0.5) / 1e6
        values += [tie, math.nextafter(tie, math.inf), math.nextafter(tie, -math.inf), random.gauss(0, 1) * 10.0 ** random.randrange(-12, 16)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (6, 4, 0):
        assert df.filter(~c.half_up("x", places).cast("string").eqNullSafe(F.round("x", places).cast("string"))).count() == 0


def test_pick_period(spark):
    item = "struct<value:string,descripcion:string,periodo:string>"
    df = spark.createDataFrame([
        (1, [("a", "A", None), ("b", "B", "00-24")]),
        (2, [("a", "A", "00-12"), ("b", "B", "00-24")]),
        (3, [("a", "A", "00-12")]),
        (4, []),
        (5, None),
        (6, [("", "", None)]),
    ], f"n int, items array<{item}>")
    got = [r[0] for r in df.orderBy("n").select(c.pick_period("items")).collect()]
    assert got == ["a", "b", None, None, None, None]


def test_lat_lon_texts(spark):
    df = spark.createDataFrame([("[39.5, -0.25]",), ("39.5,-0.25",)], "t string")
    assert {r[0] for r in df.select(c.lat_lon_text("t")).collect()} == {"39.5,-0.25"}


def test_day_partitions_are_pruned(spark, tmp_path):
    from surco.sources.tables import append_facts

    df = spark.range(100).select(
        F.col("id").cast("string").alias("parcel_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 10 as int))").alias("timestamp"),
    )
    append_facts(df, str(tmp_path / "t"), "parcel_id")
    stored = spark.read.parquet(str(tmp_path / "t"))
    late = c.since(stored, "timestamp", c.ntz("2024-01-09 00:00:00"))
    assert late.count() == 20
    plan = late._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(fecha" in plan
