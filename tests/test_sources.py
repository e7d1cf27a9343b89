"""Landed payloads and data files."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from surco.functions.columns import ntz
from surco.operators import geometry as gm, weather
from surco.sources import tables as tables, weather as ws
from surco.sources.messages import parse_positions
from surco.sources import schemas


def payloads(spark, *data, key="codigo_ine"):
    return spark.createDataFrame([(k, json.dumps(p)) for k, p in data], f"{key} string, payload string")


def test_primary_forecast_days(spark):
    daily = {
        "time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": [10.5, None], "temperature_2m_min": [1.0, 2.0],
        "weather_code": [3, 61], "relative_humidity_2m_max": [None, 90],
    }
    out = ws.primary_forecast(payloads(spark, ("46017", {"daily": daily, "latitude": 1})))
    assert rows(out, "codigo_ine", "fecha_prevision", "tmax", "tmin", "weather_code", "humedad_max", "uv_max") == [
        ("46017", date(2024, 1, 1), 10.5, 1.0, 3.0, None, None), ("46017", date(2024, 1, 2), None, 2.0, 61.0, 90.0, None)]
    raw = json.loads(out.orderBy("fecha_prevision").first().datos_raw)
    assert raw["temperature_2m_max"] == 10.5 and raw["relative_humidity_2m_max"] is None


def official(day, high, sky):
    return {"fecha": f"{day}T00:00:00", "humedadRelativa": {"maxima": high, "minima": 20}, "estadoCielo": sky}


def test_official_forecast_and_fallback(spark):
    days = [
        official("2024-01-01", 95, [{"value": "11", "descripcion": "Despejado"}]),
        official("2024-01-02", 85, [{"value": "", "descripcion": "", "periodo": "00-24"}]),
        official("2024-01-03", 75, [{"value": "x", "descripcion": "x", "periodo": "00-12"}, {"value": "12", "descripcion": "Nubes", "periodo": "00-24"}]),
        {"fecha": "2024-01-04T00:00:00"},
    ]
    second = ws.official_forecast(payloads(spark, ("46017", [{"prediccion": {"dia": days}}])))
    assert rows(second, "fecha_prevision", "estado_cielo_cod", "estado_cielo_desc") == [
        (date(2024, 1, 1), "11", "Despejado"), (date(2024, 1, 2), None, None), (date(2024, 1, 3), "12", "Nubes"), (date(2024, 1, 4), None, None)]
    daily = {"time": ["2024-01-01", "2024-01-02", "2024-01-05"], "relative_humidity_2m_max": [None, 50.0, None]}
    first = ws.primary_forecast(payloads(spark, ("46017", {"daily": daily})))
    out = weather.build_forecast(first, second, ntz("2024-01-01 06:00:00"))
    assert rows(out, "fecha_prevision", "humedad_max", "humedad_min", "estado_cielo_desc") == [
        (date(2024, 1, 1), 95.0, 20.0, "Despejado"), (date(2024, 1, 2), 50.0, 20.0, None), (date(2024, 1, 5), None, None, None)]


def test_history_blocks_and_recent_days(spark):
    parcels = spark.createDataFrame([("p", 39.0)], "parcela_id string, lat double")
    blocks = ws.history_blocks(parcels, 2005, 2026)
    got = [(r.desde.year, r.hasta.isoformat()) for r in blocks.orderBy("desde").collect()]
    assert got == [(2005, "2009-12-31"), (2010, "2014-12-31"), (2015, "2019-12-31"), (2020, "2024-12-31"), (2025, "2025-12-31")]

    body = {
        "daily": {"time": ["2024-01-01", "2024-01-02"], "et0_fao_evapotranspiration": [1.0, 2.0]},
        "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T12:00"], "soil_moisture_0_to_7cm": [0.1, 0.3], "soil_temperature_0cm": [4.0, None]},
    }
    out = ws.recent_and_forecast(payloads(spark, ("p", body), key="parcela_id"), "2024-01-01 18:00:00")
    assert rows(out, "fecha", "et0_mm", "fuente", "humedad_suelo_m3m3", "temp_suelo_c") == [
        (date(2024, 1, 1), 1.0, "observado_modelo", 0.2, 4.0), (date(2024, 1, 2), 2.0, "forecast", None, None)]
    old = ws.history(payloads(spark, ("p", {"daily": {"time": ["2023-12-31", "2024-01-01"], "et0_fao_evapotranspiration": [9.0, 9.0]}}), key="parcela_id"))
    whole = weather.union_by_priority([old, out], ["parcela_id", "fecha"])
    assert rows(whole, "fecha", "et0_mm", "fuente") == [
        (date(2023, 12, 31), 9.0, "historico_era5"), (date(2024, 1, 1), 1.0, "observado_modelo"), (date(2024, 1, 2), 2.0, "forecast")]


def test_data_files(spark, tmp_path):
    (tmp_path / "crops.json").write_text(json.dumps({"olivo": {"nombre": "Olivo", "kc_inicio": 0.65, "kc_desarrollo": 0.65, "kc_medio": 0.7, "kc_final": 0.7}, "x": {"kc_medio": 1}}))
    kc = tables.crop_reference(spark, str(tmp_path / "crops.json"))
    assert rows(kc) == [("olivo", "desarrollo", 0.65), ("olivo", "final", 0.7), ("olivo", "inicial", 0.65), ("olivo", "mediados", 0.7), ("x", "mediados", 1.0)]
    (tmp_path / "kc.csv").write_text("cultivo,fase,kc,descripcion\ntomate,inicial,0.60,x\n")
    assert rows(tables.coefficient_csv(spark, str(tmp_path / "kc.csv")), "cultivo", "kc") == [("tomate", 0.6)]
    (tmp_path / "parcels.json").write_text(json.dumps({"p1": {"cultivo": "olivo", "lat": 1.5, "regadio": True}}))
    assert rows(tables.parcel_config(spark, str(tmp_path / "parcels.json")), "parcela_id", "cultivo", "lat", "regadio") == [("p1", "olivo", 1.5, True)]
    states = [{"entity_id": "sensor.a", "state": "1", "attributes": {"device_class": "humidity"}}, {"entity_id": "b", "state": "unknown", "attributes": {}}]
    (tmp_path / "states.json").write_text(json.dumps(states))
    assert rows(tables.device_states(spark, str(tmp_path / "states.json")), "entity_id", "attributes.device_class") == [("b", None), ("sensor.a", "humidity")]


def test_exports_read_back(spark, tmp_path):
    df = spark.createDataFrame([("p", date(2024, 1, 1), 1.5)], "parcela_id string, fecha date, et0_mm double")
    wide = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                       for f in spark.createDataFrame([], schemas.DAILY_SERIES).schema])
    tables.write_csv(wide, str(tmp_path / "csv"))
    assert rows(tables.daily_series_csv(spark, str(tmp_path / "csv")), "parcela_id", "fecha", "et0_mm") == rows(df)
    tables.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().parcela_id == "p"


def test_facts_are_partitioned_by_day_and_sorted(spark, tmp_path):
    data = [(f"k{i % 7}", datetime(2024, 1, 1 + i % 3, i % 24)) for i in range(200)]
    df = spark.createDataFrame(data, "k string, timestamp timestamp_ntz")
    tables.append_facts(df, str(tmp_path / "t"), "k", batch=3)
    tables.append_facts(df, str(tmp_path / "t"), "k", batch=3)
    out = spark.read.parquet(str(tmp_path / "t"))
    assert out.count() == 200 and {r.lote for r in out.select("lote").distinct().collect()} == {3}
    for folder in (tmp_path / "t" / "lote=3").glob("fecha=*"):
        for file in folder.glob("*.parquet"):
            keys = [tuple(r) for r in spark.read.parquet(str(file)).select("k", "timestamp").collect()]
            assert keys == sorted(keys)


def test_zones_meet_on_trimmed_keys(spark):
    places = spark.createDataFrame([(" 7", "casa", "1,2", 3)], "id_place string, place_name string, place_coordinates string, radius int")
    links = spark.createDataFrame([("7 ", " v ")], "id_place string, id_victima string")
    assert rows(tables.safe_zones(places, links)) == [("v", "7", "casa", "1,2", 3.0)]


def test_unknown_positions_become_null(spark):
    df = spark.createDataFrame([(1, "P", "c", "v", 1, 2, 0.0, 0.0, 5.0)],
                               "id int, parcela_id string, cultivo string, variedad string, provincia int, municipio int, lat double, lng double, superficie double")
    assert rows(tables.parcel_dimension(df), "entity_id", "lat", "lng", "superficie") == [("1", None, None, 5.0)]


def test_positions_as_text_or_list(spark):
    body = lambda c: bytearray(json.dumps({"user_id": " u ", "coordinates": c, "timestamp": "t"}).encode())
    raw = spark.createDataFrame(
        [({}, body("39.5,-0.25"), datetime(2024, 1, 1), "1"), ({}, body([39.5, -0.25]), datetime(2024, 1, 1), "2"),
         ({}, bytearray(b"{"), datetime(2024, 1, 1), "3"), ({}, body("x"), datetime(2024, 1, 1), "4")], schemas.MESSAGE)
    assert rows(parse_positions(raw, "victima"), "user_id", "coordinates", "lat", "lon") == [("u", "39.5,-0.25", 39.5, -0.25)] * 2


def test_property_spellings_and_defaults(spark):
    data = [(1, json.dumps({"prov": 46, "MUNICIPIO": 17, "pol": "3"}), "{}"),
            (2, json.dumps({"provincia": 1}), json.dumps({"id": [9, 8, 7, 6, 5, 4], "parcelaInfo": {"dn_surface": 12345.6}, "query": [{"recinto": 2, "uso_sigpac": "TA"}]}))]
    df = spark.createDataFrame(data, "feature_id int, properties string, info string")
    assert rows(gm.normalise_properties(df, "properties", "info")) == [
        (1, 46, 17, 0, 0, 3, None, 1, 0.0, ""), (2, 9, 8, 7, 6, 5, 4, 2, 1.2346, "TA")]


@pytest.mark.parametrize("name", [n for n in dir(schemas) if n.isupper()])
def test_declared_schemas_parse(spark, name):
    ddl = getattr(schemas, name)
    spark.createDataFrame([], ddl if not ddl.startswith("map") else f"m {ddl}")


def test_headers_may_repeat_or_lack_a_key(spark):
    from surco.sources.messages import header_map

    def header(k, v):
        return (k, None if v is None else bytearray(v.encode()))

    rows_ = [([header("a", "1"), header("b", "2"), header("a", "3")],), ([header(None, "x"), header("a", None), header(None, "y")],), ([],), (None,)]
    df = spark.createDataFrame(rows_, "headers array<struct<key: string, value: binary>>")
    assert [r[0] for r in df.select(header_map("headers")).collect()] == [{"b": "2", "a": "3"}, {"a": None}, {}, {}]


def test_rows_in_order_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """Spark adds no sort by day either; a task with more days than may be open is whole all the same, and the session stays as it was."""
    monkeypatch.setattr(tables, "OPEN_FILES", 3)
    df = spark.range(2000, numPartitions=2).select(F.lit("a").alias("k"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id)").alias("timestamp"))
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    tables.append_facts(df, str(tmp_path / "t"), "k", batch=1, dealt=True, ordered=True)
    assert spark.conf.get(name, None) == before
    out = spark.read.parquet(str(tmp_path / "t"))
    assert rows(out, "timestamp") == rows(df, "timestamp") and out.select("fecha").distinct().count() == 84
    assert [r.timestamp for r in out.filter("fecha = '2024-01-01'").collect()] == sorted(r.timestamp for r in out.filter("fecha = '2024-01-01'").collect())
