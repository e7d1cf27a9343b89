"""Streams on landed files give what the batch operators give."""

import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows
from surco.operators import proximity, readings as rd
from surco.sources import schemas
from surco.sources.messages import file_messages, parse_messages, parse_positions
from surco.sources.tables import append_facts, parcel_dimension
from surco.streaming import run
from surco.streaming.state import StateLog

START = datetime(2024, 1, 1)


def message(n, seconds, kind="parcela", entity="1", sensor="temperatura", value=1.0, sensor_id="s", body=None):
    attrs = {"entity_type": kind, "entity_id": entity, "sensor_tipo": sensor, "usuario_id": "u"}
    text = body if body is not None else json.dumps({"valor": value, "sensor_entity_id": sensor_id})
    return (attrs, bytearray(text.encode()), START + timedelta(seconds=seconds), f"{n:06d}")


def land(spark, folder, *batches):
    """Each batch as one file, in order."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(list(batch), schemas.MESSAGE).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def closing(seconds=10**6):
    return [message(999999, seconds, kind="cierre", entity="cierre", sensor="cierre")]


def parcels(spark):
    return spark.createDataFrame(
        [(1, 7, "P1", "olivo", "v", 46, 17, "uno", 0.0, 1.0, 2.0), (2, 7, "P2", "vid", "w", 28, 79, "dos", 3.0, 1.0, 2.0)],
        "id int, usuario_id int, parcela_id string, cultivo string, variedad string, provincia int, municipio int, "
        "nombre string, lat double, lng double, superficie double",
    )


def forecast(spark):
    schema = (
        "codigo_ine string, fecha_prevision date, tmax double, tmin double, humedad_max double, humedad_min double, "
        "precipitacion_mm double, et0_evapotranspiracion double, radiacion_solar double, weather_code int, estado_cielo_desc string"
    )
    return spark.createDataFrame([("46017", START.date(), 10.0, 2.0, 80.0, 40.0, 1.0, 2.0, 3.0, 0, "")], schema)


def test_hourly_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    def pushed(n, seconds, kind, value, parcel=1):
        body = {"sensor_type": kind, "parcela_usuario_id": parcel, "user_id": "u", "value": str(value), "sensor_id": "s"}
        return (None, bytearray(json.dumps(body).encode()), START + timedelta(seconds=seconds), f"{n:06d}")

    kinds = ["temperature", "ambient_humidity", "soil_moisture"]
    first = [pushed(i, 97 * i, kinds[i % 3], i) for i in range(100)]
    second = [pushed(100 + i, 97 * (100 + i), kinds[i % 3], i, 2) for i in range(100)] + [pushed(300, 20000, "temperature", "n/a")]
    end = [pushed(999, 10**6, "temperature", 1)]
    folder, facts, place = tmp_path / "in", str(tmp_path / "facts"), str(tmp_path / "cp")
    start = lambda: run.hourly_fields(file_messages(spark, str(folder)), lambda: parcel_dimension(parcels(spark)), facts, checkpoint=place)
    land(spark, folder, first)
    finish(start())
    land(spark, folder, second)
    finish(start())
    land(spark, folder, end)
    finish(start())
    got = rows(spark.read.parquet(facts).drop("fecha", "lote"))

    raw = spark.createDataFrame(first + second, schemas.MESSAGE)
    ok, _ = parse_messages(raw, attrs=False)
    batch = rd.sensor_pivot(rd.coerce_numeric(ok), types=run.V1_TYPES)
    want = rd.field_rows(batch, parcel_dimension(parcels(spark))).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    assert got == rows(want) and len(got) > 5


def test_late_rows_are_dropped(spark, tmp_path):
    folder, facts, place = tmp_path / "in", str(tmp_path / "facts"), str(tmp_path / "cp")
    houses = lambda: spark.createDataFrame([(1, 7, "g")], "id int, usuario_id int, nombre string")
    plants = lambda: spark.createDataFrame([(10, 1, "tomate", "a")], "id int, invernadero_id int, tipo string, variedad string")
    go = lambda: finish(run.plants(file_messages(spark, str(folder)), houses, plants, facts, checkpoint=place))
    land(spark, folder, [message(1, 10, "invernadero", value=20.0), message(2, 20, "planta", "10", value=22.0)])
    go()
    land(spark, folder, [message(3, 5000, "planta", "10", value=30.0)])
    go()
    land(spark, folder, [message(4, 30, "planta", "10", value=99.0), message(5, 5001, "planta", "10", value=32.0)])
    go()
    land(spark, folder, [message(6, 10**6, "planta", "10", value=0.0)])
    go()
    out = spark.read.parquet(facts)
    assert rows(out, "plant_id", "temperatura", "timestamp") == [
        ("10", 21.0, START), ("10", 31.0, START + timedelta(seconds=4800))]


def test_plant_fan_out_stream_equals_batch(spark, tmp_path):
    houses = spark.createDataFrame([(i, 7, f"g{i}") for i in range(3)], "id int, usuario_id int, nombre string")
    plants = spark.createDataFrame([(i, i % 4, "t", "v") for i in range(12)], "id int, invernadero_id int, tipo string, variedad string")
    sensors = ["temperatura", "humedad_ambiental", "humedad_suelo"]
    data = [message(i, 11 * i, "planta" if i % 3 else "invernadero", str(i % 13 if i % 3 else i % 5), sensors[i % 3 if i % 2 else 0], float(i)) for i in range(300)]
    land(spark, tmp_path / "in", data[:150], data[150:], [message(999, 10**6, "planta", "zz")])
    facts = str(tmp_path / "facts")
    finish(run.plants(file_messages(spark, str(tmp_path / "in"), 1), lambda: houses, lambda: plants, facts, checkpoint=str(tmp_path / "cp")))
    got = rows(spark.read.parquet(facts).drop("fecha", "lote"))
    ok, _ = parse_messages(spark.createDataFrame(data, schemas.MESSAGE))
    want = rd.fanout_mean(rd.coerce_numeric(ok), houses, plants).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    assert got == rows(want) and got


def test_plant_rows_are_written_where_they_are_summed(spark, tmp_path, monkeypatch):
    """The written rows of a closed window come by one shuffle behind the join, none of their own."""
    houses = spark.createDataFrame([(1, 7, "g")], "id int, usuario_id int, nombre string")
    plants = spark.createDataFrame([(i, 1, "t", "v") for i in range(5)], "id int, invernadero_id int, tipo string, variedad string")
    land(spark, tmp_path / "in", [message(1, 10, "invernadero", value=20.0)], [message(9, 10**6, "planta", "zz")])
    plans = []

    def stored(df, *args, **how):
        assert how.get("dealt")
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("Join")[0])
        append_facts(df, *args, **how)

    append_facts = run.append_facts
    monkeypatch.setattr(run, "append_facts", stored)
    finish(run.plants(file_messages(spark, str(tmp_path / "in"), 1), lambda: houses, lambda: plants, str(tmp_path / "facts"), checkpoint=str(tmp_path / "cp")))
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 5
    assert plans and all(p.count("Exchange") == 1 for p in plans)


def test_baseline_stream_emits_quiet_parcels_and_state(spark, tmp_path):
    data = [message(1, 5, value=9.0, sensor_id=""), message(2, 6, value=11.0, sensor_id="s2"), message(3, 7, sensor="humedad_suelo", value=33.0),
            message(4, 8, entity="99", value=1.0), message(5, 700, value=15.0), message(6, 1300, value=50.0)]
    land(spark, tmp_path / "in", data, [message(999, 10**6)])
    spark.createDataFrame([(START + timedelta(seconds=s), f"t{s}") for s in (1, 601, 10**6)], "event_time timestamp, message_id string").write.parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("event_time timestamp, message_id string").parquet(str(tmp_path / "ticks"))
    state = run.field_state(str(tmp_path / "state"))
    dims = lambda: run.parcels_with_weather(parcels(spark), forecast(spark), "2024-01-02")
    finish(run.baseline_fields(file_messages(spark, str(tmp_path / "in")), ticks, dims, str(tmp_path / "facts"), state,
                               as_of=F.lit(START).cast("timestamp_ntz"), checkpoint=str(tmp_path / "cp")))
    out = spark.read.parquet(str(tmp_path / "facts"))
    ten = START + timedelta(minutes=10)
    assert rows(out, "parcel_id", "timestamp", "temperatura", "humedad_suelo", "fuente_temperatura", "estado_cielo", "sensor_id") == [
        ("1", START, 10.0, 33.0, "sensor", "Despejado", "s2"), ("1", ten, 15.0, None, "sensor", "Despejado", "s"),
        ("2", START, None, None, "openmeteo", None, None), ("2", ten, None, None, "openmeteo", None, None)]
    held = state.read(spark)
    # The soil value of the first window stays, the later window had none.
    assert rows(held, "parcel_id", "temperatura", "humedad_suelo", "humedad_ambiental") == [("1", 15.0, 33.0, 60.0), ("2", None, None, None)]


def test_plant_values_and_compaction(spark, tmp_path):
    houses = lambda: spark.createDataFrame([(1, 7, "g")], "id int, usuario_id int, nombre string")
    plants = lambda: spark.createDataFrame([(10, 1, "t", "v")], "id int, invernadero_id int, tipo string, variedad string")
    state = run.plant_state(str(tmp_path / "state"))
    land(spark, tmp_path / "in", [message(1, 1, "invernadero", "1", value=5.0), message(2, 2, "planta", "10", value=6.0)],
         [message(3, 3, "planta", "10", value=None), message(4, 4, "planta", "77", value=1.0)])
    q = run.plant_values(file_messages(spark, str(tmp_path / "in"), 1), houses, plants, state, F.lit(START).cast("timestamp_ntz"), str(tmp_path / "cp"))
    finish(q)
    want = [("1", None, 5.0), ("1", "10", None)]
    assert rows(state.read(spark), "greenhouse_id", "plant_id", "valor") == want
    state.compact(spark)
    assert rows(state.read(spark), "greenhouse_id", "plant_id", "valor") == want


def test_state_log_counts_a_repeated_batch_once(spark, tmp_path):
    log = StateLog(str(tmp_path / "s"), ["k"], ["v"], ["t"])
    df = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "k int, v int, t int")
    log.write(df, 0)
    log.write(df, 0)
    log.write(df.filter("t = 1"), 1)
    assert rows(log.read(spark)) == [(1, 5)]
    assert spark.read.parquet(log.path + "/log").count() == 2


def test_state_log_compacts_itself_and_skips_unfinished_folders(spark, tmp_path):
    log = StateLog(str(tmp_path / "s"), ["k"], ["v", "w"], ["t"], skip_nulls=True, compact_every=3)
    schema = "k int, v int, w int, t int"
    for batch in range(8):
        log.write(spark.createDataFrame([(batch % 2, batch, batch if batch < 2 else None, 1), (9, batch, None, 1)], schema), batch)
    assert sorted(p.name for p in (tmp_path / "s" / "base").iterdir()) == ["lote=2", "lote=5"]
    want = [(0, 6, 0), (1, 7, 1), (9, 7, None)]
    assert rows(log.read(spark)) == want
    (tmp_path / "s" / "base" / "lote=5" / "_SUCCESS").unlink()
    assert rows(log.read(spark)) == want
    (tmp_path / "s" / "log" / "lote=7" / "_SUCCESS").unlink()
    assert rows(log.read(spark)) == [(0, 6, 0), (1, 5, 1), (9, 6, None)]


def test_state_log_stays_bounded(spark, tmp_path):
    """Forty batches leave two bases and what came since the older one; a reader from before a compaction still finds its folders."""
    log = StateLog(str(tmp_path / "s"), ["k"], ["v"], ["t"], compact_every=5)
    before = None
    for batch in range(40):
        log.write(spark.createDataFrame([(batch % 7, batch, 1)], "k int, v int, t int"), batch)
        if batch == 34:
            before = log.read(spark)  # planned before the compaction that batch 35 brings
    assert sorted(int(p.name.split("=")[1]) for p in (tmp_path / "s" / "base").iterdir()) == [29, 34]
    assert sorted(int(p.name.split("=")[1]) for p in (tmp_path / "s" / "log").iterdir()) == list(range(30, 40))
    assert rows(before) == sorted((k, max(b for b in range(35) if b % 7 == k)) for k in range(7))
    assert rows(log.read(spark)) == sorted((k, max(b for b in range(40) if b % 7 == k)) for k in range(7))


def test_compaction_by_a_job_of_its_own(spark, tmp_path):
    log = StateLog(str(tmp_path / "s"), ["k"], ["v"], ["t"], compact_every=None)
    for batch in range(6):
        log.write(spark.createDataFrame([(1, batch, 1)], "k int, v int, t int"), batch)
        if batch in (2, 4):
            log.compact(spark, batch - 1)
    assert sorted(p.name for p in (tmp_path / "s" / "base").iterdir()) == ["lote=1", "lote=3"]
    assert sorted(p.name for p in (tmp_path / "s" / "log").iterdir()) == ["lote=2", "lote=3", "lote=4", "lote=5"]
    log.compact(spark, 3)  # nothing new
    assert rows(log.read(spark)) == [(1, 5)]


def test_refresh_keeps_two_loads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(run, "shared_folder", lambda session: str(tmp_path / "shared"))
    now = [0.0]
    held = run.Refreshed(lambda: spark.range(int(now[0]) + 1), 1, lambda: now[0])
    for t in range(6):
        now[0] = float(2 * t)
        known = held.get()
    assert known.count() == 11 and len(list((tmp_path / "shared").iterdir())) == 2


def test_quarantine_holds_broken_messages(spark, tmp_path):
    bad = [message(1, 1, body="{"), message(2, 2, body='["x"]'), (None, bytearray(b'{"valor": 1}'), START, "3"),
           ({"entity_id": "1"}, bytearray(b"\xff\xfe"), START, "4"), message(5, 5, value=None)]
    land(spark, tmp_path / "in", bad)
    finish(run.quarantine(file_messages(spark, str(tmp_path / "in")), str(tmp_path / "bad"), checkpoint=str(tmp_path / "cp")))
    got = rows(spark.read.parquet(str(tmp_path / "bad")), "message_id", "reason")
    assert got == [("000001", "broken json"), ("000002", "broken json"), ("3", "no attributes"), ("4", "no body")]


def test_nearby_stream_equals_batch(spark, tmp_path):
    def position(n, seconds, user, lat, listed=False):
        where = [lat, -0.3] if listed else f"{lat},-0.3"
        body = {"user_id": user, "coordinates": where, "timestamp": f"2024-01-01T00:00:{n:02d}"}
        return ({}, bytearray(json.dumps(body).encode()), START + timedelta(seconds=seconds), f"{n:06d}")

    victims = [position(n, n, f"v{n % 3}", 39 + n / 10000, n % 2 == 0) for n in range(30)]
    others = [position(40 + n, n, f"a{n % 2}", 39.002 + n / 10000) for n in range(19)]
    late = 10**6
    land(spark, tmp_path / "v", victims, [position(98, late, "v0", 10.0)])
    land(spark, tmp_path / "a", others, [position(99, late, "a0", 80.0)])
    links = spark.createDataFrame([("v0", "a0", 300.0), ("v1", "a1", None), ("v2", "a0", 90.0)], "id_victima string, id_agresor string, dist_seguridad double")
    zones = spark.createDataFrame([("v2", "7", "casa", "39.002,-0.300", 400.0)], "id_victima string, id_place string, place_name string, place_coordinates string, radius double")
    facts, place = str(tmp_path / "facts"), str(tmp_path / "state")
    finish(run.nearby(
        parse_positions(file_messages(spark, str(tmp_path / "v")), "victima"),
        parse_positions(file_messages(spark, str(tmp_path / "a")), "agresor"),
        lambda: links, lambda: zones, facts, place, checkpoint=str(tmp_path / "cp")))
    both = parse_positions(spark.createDataFrame(victims, schemas.MESSAGE), "victima").union(
        parse_positions(spark.createDataFrame(others, schemas.MESSAGE), "agresor"))
    want = proximity.proximity_alerts(both, links, zones)
    got = spark.read.parquet(facts).drop("lote")
    assert rows(got) == rows(want) and got.filter("alerta = 'place'").count() and got.filter("alerta = 'fisica'").count()
    assert run.alert_log(place).read(spark).count() == want.select(proximity.alert_key()).distinct().count()


def test_pushed_readings_use_the_registry_of_the_moment(spark, tmp_path):
    known = [("s1", "temperature", 1, 7, True)]
    registry = lambda: spark.createDataFrame(known, "sensor_id string, sensor_type string, location_id int, user_id int, active boolean")
    schema = "sensor_id string, value string"

    def go():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        finish(run.pushed(stream, registry, str(tmp_path / "ok"), str(tmp_path / "bad"), checkpoint=str(tmp_path / "cp")))

    spark.createDataFrame([("s1", "1"), ("s2", "2"), (None, "3")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    go()
    known.append(("s2", "valve", 2, 7, True))
    spark.createDataFrame([("s2", "4")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert rows(spark.read.parquet(str(tmp_path / "ok")), "sensor_id", "value") == [("s1", "1"), ("s2", "4")]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_refresh_keeps_the_last_good_dimension(spark):
    now, loads = [0.0], []

    def load():
        loads.append(now[0])
        if len(loads) == 2:
            raise OSError("down")
        return spark.range(len(loads))

    held = run.Refreshed(load, 10, lambda: now[0])
    assert held.get().count() == 1
    now[0] = 5
    assert held.get().count() == 1 and len(loads) == 1
    now[0] = 11
    assert held.get().count() == 1 and held.failures == 1
    now[0] = 12
    assert held.get().count() == 3


def test_refresh_survives_a_source_that_fails_when_read(spark):
    now, loads = [0.0], []

    def load():
        loads.append(now[0])
        rows = spark.range(1)
        return rows if len(loads) == 1 else rows.filter(F.raise_error(F.lit("gone")).cast("boolean"))

    held = run.Refreshed(load, 10, lambda: now[0])
    assert held.get().count() == 1
    now[0] = 11
    assert held.get().count() == 1 and held.failures == 1


def test_append_checks_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("1", START)], "k string, timestamp timestamp_ntz")
    with pytest.raises(ValueError, match="does not exist"):
        append_facts(df, path, "k", create=False)
    append_facts(df, path, "k")
    append_facts(df, path, "k", create=False)
    with pytest.raises(ValueError, match="columns differ"):
        append_facts(df.withColumn("x", F.lit(1)), path, "k", create=False)
    assert spark.read.parquet(path).count() == 2


def test_windows_that_only_close_are_not_taken_for_few(spark, tmp_path):
    land(spark, tmp_path / "in", [message(i, i, entity=str(i)) for i in range(3000)] + closing())
    ok, _ = parse_messages(file_messages(spark, str(tmp_path / "in")))
    held = run.closed_windows(run.watermarked(rd.coerce_numeric(ok)), "1 hour").select("entity_id", "valor")
    seen, plans, sessions = [], [], []

    def each(batch, number):
        other = batch.sparkSession.range(100_000).select(F.col("id").cast("string").alias("entity_id"))
        met = batch.join(other, "entity_id")
        seen.append(len(met.collect()))
        plans.append(met._jdf.queryExecution().executedPlan().toString())
        sessions.append(batch.sparkSession)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10000")
    try:
        finish(run.start(held, "closing", each, str(tmp_path / "cp")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(seen) == 3000
    assert all("BroadcastHashJoin" not in p for p, n in zip(plans, seen) if n)
    # Streams plan their state without adaptive execution, so the session is left as it was.
    assert sessions[-1].conf.get("spark.sql.adaptive.enabled") == "false"
    assert sessions[-1].conf.get("spark.sql.autoBroadcastJoinThreshold") == "10000"


def test_baseline_tasks_grow_with_the_rows(spark, tmp_path, monkeypatch):
    """A task unfolds a bounded number of rows, whatever the shuffle partitions are, and every row is written once, in order."""
    monkeypatch.setattr(run, "FACTS_PER_TASK", 300)
    many = parcels(spark).crossJoin(spark.range(10).withColumnRenamed("id", "more")).withColumn("id", F.col("id") + 10 * F.col("more").cast("int")).drop("more")
    land(spark, tmp_path / "in", [message(1, 5, value=9.0), message(2, 40 * 3600, value=15.0)], [message(999, 10**7)])
    spark.createDataFrame([(START + timedelta(seconds=s), f"t{s}") for s in (1, 40 * 3600, 10**7)], "event_time timestamp, message_id string").write.parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("event_time timestamp, message_id string").parquet(str(tmp_path / "ticks"))
    state = run.field_state(str(tmp_path / "state"))
    finish(run.baseline_fields(file_messages(spark, str(tmp_path / "in")), ticks, lambda: run.parcels_with_weather(many, forecast(spark), "2024-01-02"),
                               str(tmp_path / "facts"), state, as_of=F.lit(START).cast("timestamp_ntz"), checkpoint=str(tmp_path / "cp")))
    out = spark.read.parquet(str(tmp_path / "facts"))
    windows = 40 * 6 + 1
    assert out.count() == out.select("parcel_id", "timestamp").distinct().count() == 20 * windows
    files = out.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert max(r.n for r in files) <= 3 * 300 and len(files) >= 20 * windows // 900
    assert rows(state.read(spark).filter("parcel_id = '1'"), "temperatura", "humedad_ambiental") == [(15.0, 60.0)]


def test_baseline_facts_come_in_order_and_the_state_from_few_rows(spark, tmp_path, monkeypatch):
    """Facts are dealt and sorted as days, so no row is sorted again; the latest values are not picked from all of them."""
    monkeypatch.setattr(run, "FACTS_PER_TASK", 1000)
    how, changed = {}, []
    monkeypatch.setattr(run, "append_facts", lambda df, *args, **named: (how.update(named), append_facts(df, *args, **named)))
    written = StateLog.write
    monkeypatch.setattr(StateLog, "write", lambda self, changes, batch: (changed.append(changes.count()), written(self, changes, batch)))
    data = [message(i, 700 * i, entity=str(1 + i % 3), value=float(i)) for i in range(200)]
    land(spark, tmp_path / "in", data, [message(999, 10**7)])
    spark.createDataFrame([(START + timedelta(seconds=s), f"t{s}") for s in (1, 40 * 3600, 10**7)], "event_time timestamp, message_id string").write.parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("event_time timestamp, message_id string").parquet(str(tmp_path / "ticks"))
    state = run.field_state(str(tmp_path / "state"))
    finish(run.baseline_fields(file_messages(spark, str(tmp_path / "in")), ticks, lambda: run.parcels_with_weather(parcels(spark), forecast(spark), "2024-01-02"),
                               str(tmp_path / "facts"), state, as_of=F.lit(START).cast("timestamp_ntz"), checkpoint=str(tmp_path / "cp")))
    out = spark.read.parquet(str(tmp_path / "facts"))
    windows = 40 * 6 + 1
    assert out.count() == 2 * windows and how["ordered"]
    assert sum(changed) <= 200 + 2 * 2
    for f in out.inputFiles():
        at = [(r.parcel_id, r.timestamp) for r in spark.read.parquet(f).collect()]
        assert at == sorted(at)
    late = rows(state.read(spark), "parcel_id", "temperatura", "humedad_ambiental", "fuente_temperatura")
    last = lambda k: max(i for i in range(200) if i % 3 == k and 700 * i < 600 * windows)
    assert late == [("1", 6.0, 60.0, "openmeteo"), ("2", float(last(1)), None, "openmeteo")]


def test_open_windows_of_the_baseline_lie_on_disk(spark, smallest):
    """The whole table is one batch, so its windows are held all at once; only the run's own session is set so."""
    from surco.plans import streams

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    job, _ = streams.run_baseline(spark, smallest)
    kept = {f.suffix for f in Path(job.path("checkpoint")).glob("state/0/*/*") if not f.name.startswith((".", "_"))}
    assert kept & {".changelog", ".zip"} and ".delta" not in kept
    assert spark.conf.get(provider, None) == before
