"""Keyed tables, weather rows, balance and actions on small cases."""

import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from surco.operators import actions as act, balance, context as cx, nesting, tables as tb, weather


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_upsert_is_idempotent_and_respects_nulls(spark):
    old = frame(spark, "k int, a int, b string, owner string", (1, 1, "x", "o1"), (2, 2, "y", "o2"))
    new = frame(spark, "k int, a int, b string, owner string, t int",
                (1, None, "z", "n1", 1), (1, 5, None, "n2", 2), (3, 7, "w", "n3", 1), (3, 8, "v", "n4", 2))
    once = tb.merge_latest(old, new, ["k"], ["a", "b"], ["t"], ["owner"])
    assert rows(once) == [(1, 5, None, "o1"), (2, 2, "y", "o2"), (3, 8, "v", "n3")]
    assert rows(tb.merge_latest(once, new, ["k"], ["a", "b"], ["t"], ["owner"])) == rows(once)
    kept = tb.merge_latest(old, new, ["k"], ["a", "b"], ["t"], ["owner"], skip_nulls=True)
    assert rows(kept) == [(1, 5, "z", "o1"), (2, 2, "y", "o2"), (3, 8, "v", "n3")]


def test_event_precedence_keeps_newer_stored_value(spark):
    old = frame(spark, "k int, a int, t int", (1, 1, 10))
    new = frame(spark, "k int, a int, t int", (1, 2, 5))
    by = lambda p: rows(tb.merge_latest(old, new, ["k"], ["a"], ["t"], precedence=p), "a")
    assert by("event") == [(1,)]
    assert by("arrival") == [(2,)]


def test_sync_keeps_names_and_deactivates(spark):
    current = frame(spark, "c string, lat double, nombre string, activo boolean", ("a", 1.0, "A", True), ("b", 2.0, "B", True))
    wanted = frame(spark, "c string, lat double, nombre string", ("b", 9.0, "other"), ("c", 3.0, "C"))
    out = tb.sync_dimension(current, wanted, "c", ["lat"], ["nombre"])
    assert rows(out) == [("a", 1.0, "A", False), ("b", 9.0, "B", True), ("c", 3.0, "C", True)]


def test_insert_if_absent_returns_rejects(spark):
    stored = frame(spark, "k int", (1,))
    new = frame(spark, "k int, t int", (1, 1), (2, 2), (2, 1), (3, 5))
    ok, bad = tb.insert_if_absent(stored, new, ["k"], ["t"])
    assert rows(ok) == [(2, 1), (3, 5)]
    assert rows(bad) == [(1, 1), (2, 2)]


def test_delete_needs_the_owner_and_cascades(spark):
    houses = frame(spark, "id int, owner int", (1, 7), (2, 8))
    plants = frame(spark, "id int, house int", (10, 1), (11, 2))
    asked = frame(spark, "id int, owner int", (1, 7), (2, 7))
    left, (kept,) = tb.delete_cascade(houses, asked, ["id", "owner"], [(plants, "house", "id")])
    assert rows(left) == [(2, 8)] and rows(kept) == [(11, 2)]


def test_update_sets_null_too(spark):
    df = frame(spark, "k int, a string", (1, "x"), (2, "y"))
    change = frame(spark, "k int, a string", (1, None))
    assert rows(tb.update_by_key(df, change, ["k"], ["a"])) == [(1, None), (2, "y")]


def test_array_columns(spark):
    df = frame(spark, "k int, z array<struct<id:string,n:int>>", (1, None), (2, [("a", 1), (None, 2)]))
    grown = tb.array_append(df, "z", F.struct(F.lit("b").alias("id"), F.lit(3).alias("n")))
    assert [r.z for r in grown.orderBy("k").collect()] == [[("b", 3)], [("a", 1), (None, 2), ("b", 3)]]
    cut = tb.array_remove(df, "z", F.lit("a"))
    assert [r.z for r in cut.orderBy("k").collect()] == [[], []]


def test_migrate_and_checks(spark):
    df = frame(spark, "a int, old string", (1, "x"), (2, None))
    ok, bad = tb.migrate(df, {"old": "new"}, {"kind": "string"}, {"kind": "parcela"}, {"new": ["x"], "kind": ["parcela"]})
    assert rows(ok) == [(1, "x", "parcela")]
    assert rows(bad, "a", "reason") == [(2, "new")]


def test_keep_last_with_ties_and_latest_non_null(spark):
    df = frame(spark, "k int, t int, id int, v string", (1, 1, 1, "a"), (1, 2, 2, "b"), (1, 2, 3, None))
    assert rows(tb.keep_last(df, ["k"], ["t", "id"])) == [(1, 2, 3, None)]
    assert rows(tb.latest_non_null(df, ["k"], "v", ["t", "id"])) == [(1, "b")]


# ---- weather and balance --------------------------------------------------

def test_weather_means_need_both_parts_and_future_rows_do_not_count(spark):
    schema = (
        "codigo_ine string, fecha_prevision date, tmax double, tmin double, humedad_max double, humedad_min double, "
        "precipitacion_mm double, et0_evapotranspiracion double, radiacion_solar double, weather_code int, estado_cielo_desc string"
    )
    forecast = frame(spark, schema,
                     ("46017", date(2024, 1, 1), 10.0, 2.0, 80.0, None, 1.0, 2.0, 3.0, 0, ""),
                     ("46017", date(2024, 1, 9), 99.0, 99.0, 80.0, 40.0, 1.0, 2.0, 3.0, 0, ""),
                     ("28079", date(2024, 1, 9), 99.0, 99.0, 80.0, 40.0, 1.0, 2.0, 3.0, 0, ""))
    parcels = frame(spark, "id int, provincia int, municipio int", (1, 46, 17), (2, 28, 79), (3, None, None))
    out = weather.join_weather(parcels, forecast, "2024-01-05")
    assert rows(out, "id", "temperatura", "humedad_ambiental", "estado_cielo") == [
        (1, 6.0, None, "Despejado"), (2, None, None, None), (3, None, None, None)]


def test_asof_takes_the_last_day_at_or_before(spark):
    daily = frame(spark, "k int, d date, v int", (1, date(2024, 1, 2), 2), (1, date(2024, 1, 5), 5))
    asked = frame(spark, "k int, dia date, id int", (1, date(2024, 1, 1), 1), (1, date(2024, 1, 2), 2),
                  (1, date(2024, 1, 4), 3), (1, date(2024, 1, 9), 4), (2, date(2024, 1, 9), 5))
    out = weather.asof_by_day(asked, daily, "k", "dia", "d", ["v"])
    assert rows(out, "id", "v") == [(1, None), (2, 2), (3, 2), (4, 5), (5, None)]


def test_union_by_priority_fills_and_keeps_last_frame(spark):
    a = frame(spark, "k int, d int, x int", (1, 1, 10), (1, 2, 20))
    b = frame(spark, "k int, d int, x int, soil int", (1, 2, 21, 5))
    assert rows(weather.union_by_priority([a, b], ["k", "d"])) == [(1, 1, 10, None), (1, 2, 21, 5)]


def test_balance_keeps_nulls_but_advice_counts_them_as_zero(spark):
    kc = frame(spark, "cultivo string, fase string, kc double", ("olivo", "mediados", 0.7))
    days = frame(spark, "cultivo string, et0_mm double, precipitacion_mm double",
                 ("olivo", 5.0, None), ("olivo", None, 1.0), ("olivo", 5.0, 9.0), ("olivo", 5.0, 1.0), ("palma", 5.0, 1.0))
    out = balance.water_balance(days, kc)
    assert [(r.etc_mm, r.deficit_hidrico_mm) for r in out.collect()] == [
        (3.5, None), (None, None), (3.5, 0.0), (3.5, 2.5), (None, None)]

    day = "array<struct<fecha:date,et0_mm:double,precipitacion_mm:double,prob_precipitacion:double,estado_cielo_desc:string>>"
    asked = frame(spark, f"parcela_id string, codigo_ine string, cultivo string, fase string, prevision {day}",
                  ("p1", "1", "olivo", "mediados", [(date(2024, 1, 1), 5.0, None, None, None)]),
                  ("p2", "1", "olivo", "mediados", []), ("p3", "1", "olivo", "otra", None), ("p4", "9", "olivo", "mediados", None))
    forecast = frame(spark, "codigo_ine string, fecha_prevision date, et0_evapotranspiracion double, precipitacion_mm double, "
                     "prob_precipitacion double, estado_cielo_desc string", ("1", date(2024, 1, 2), None, 3.0, 10.0, "Sol"))
    advice, bad = balance.recommend(asked, forecast, kc)
    assert rows(advice, "parcela_id", "etc_mm", "deficit_mm", "prob_precipitacion") == [("p1", 3.5, 3.5, 0.0), ("p2", 0.0, 0.0, 10.0)]
    assert rows(bad, "parcela_id", "reason") == [
        ("p3", "unknown crop or phase"), ("p4", "no forecast for the municipality")]
    nested = balance.nest_advice(advice).orderBy("parcela_id").collect()
    assert [len(r.recomendacion_dias) for r in nested] == [1, 1]


def test_requests_take_the_code_of_their_parcel(spark):
    day = balance.DAY
    asked = frame(spark, f"parcela_id string, codigo_ine string, cultivo string, fase string, prevision array<{day}>",
                  ("p1", None, "c", "f", None), ("p2", "28079", "c", "f", None), ("p9", "", "c", "f", []),
                  ("p8", None, "c", "f", [(date(2024, 1, 1), 1.0, 1.0, None, None)]))
    parcels = frame(spark, "parcela_id string, provincia int, municipio int", ("p1", 46, 17), ("p2", 1, 1))
    ok, bad = balance.with_municipality(asked, parcels)
    assert rows(ok, "parcela_id", "codigo_ine") == [("p1", "46017"), ("p2", "28079"), ("p8", None)]
    assert rows(bad, "parcela_id", "reason") == [("p9", "parcel not found")]


def test_scenarios_pair_dry_with_hot(spark):
    et0 = frame(spark, "parcela_id string, fecha date, et0_p25 double, et0_p50 double, et0_p75 double", ("p", date(2024, 1, 1), 1.0, 2.0, 3.0))
    rain = frame(spark, "parcela_id string, fecha date, precip_p25 double, precip_p50 double, precip_p75 double", ("p", date(2024, 1, 1), 0.0, 0.5, 9.0))
    kc = frame(spark, "parcela_id string, kc double", ("p", 0.5))
    row = balance.scenarios(et0, rain, kc).first()
    assert (row.etc_pesimista, row.deficit_pesimista) == (1.5, 1.5)
    assert (row.etc_neutro, row.deficit_neutro) == (1.0, 0.5)
    assert (row.etc_optimista, row.deficit_optimista) == (0.5, 0.0)


# ---- context --------------------------------------------------------------

def test_stats_guard_edge_and_daily_mode(spark):
    schema = "parcel_id string, timestamp timestamp_ntz, temperatura double, humedad_suelo double, humedad_ambiental double, precipitacion_mm double, et0 double"
    df = frame(spark, schema,
               ("1", datetime(2024, 1, 1, 0), 10.0, 1.0, None, 5.0, 1.0),
               ("1", datetime(2024, 1, 1, 12), 20.0, 3.0, None, 5.0, 1.0),
               ("1", datetime(2023, 12, 31, 23, 59), 99.0, 9.0, None, 5.0, 1.0),
               ("2", datetime(2024, 1, 1, 1), None, 7.0, None, 5.0, 1.0))
    out = cx.stats_24h(df, "2024-01-02 00:00:00")
    assert rows(out) == [("1", 15.0, 2.0, None), ("2", None, None, None)]
    assert rows(cx.stats_7d(df, "2024-01-02 00:00:00"), "parcel_id", "precipitacion_mm_acumulado") == [("1", 15.0), ("2", None)]
    daily = cx.stats_7d(df, "2024-01-02 00:00:00", mode="daily")
    assert rows(daily, "parcel_id", "precipitacion_mm_acumulado") == [("1", 10.0), ("2", None)]


def test_decayed_response_equals_brute_force(spark):
    import math
    import random

    rnd = random.Random(3)
    start = datetime(2024, 1, 1)
    hits = [(rnd.choice("ab"), datetime(2023, 12, 20) .replace() if i % 9 == 0 else datetime(2024, 1, rnd.randint(1, 9), rnd.randint(0, 23), rnd.randint(0, 59)), rnd.random()) for i in range(80)]
    entities = frame(spark, "k string", ("a",), ("b",), ("c",))
    events = spark.createDataFrame(hits, "k string, t timestamp_ntz, amp double")
    out = cx.decayed_response(entities, events, "k", "t", "amp", 0.4, "2024-01-01", 240, "1 hour", base=1.0, high=3.0)
    got = {(r.k, r.ts): r.respuesta for r in out.collect()}
    assert len(got) == 720
    for (k, ts), value in got.items():
        total = 1.0 + sum(a * math.exp(-0.4 * (ts - t).total_seconds() / 86400) for kk, t, a in hits if kk == k and t <= ts)
        assert value == pytest.approx(min(total, 3.0), rel=1e-9)
    assert min(ts for _, ts in got) == start


# ---- actions --------------------------------------------------------------

def test_action_times(spark):
    schema = "user_id string, entity_type string, entity_id string, tipo_evento string, valor string, fecha string, timestamp string, n int"
    one = lambda n, fecha=None, ts=None, user="u", tipo="riego", ent="1": (user, None, ent, tipo, None, fecha, ts, n)
    df = frame(spark, schema, one(1, fecha="2024-02-01"), one(2, ts="2024-02-01T08:30:00+02:00"), one(3, ts="2024-02-01T08:30:00Z"),
               one(4), one(5, fecha="2024-13-01"), one(6, ts="mañana"), one(7, user=None), one(8, tipo="siega"), one(9, ent=""))
    ok, bad = act.validate_actions(df, "2024-05-05 05:05:05")
    assert rows(ok, "n", "timestamp", "entity_type") == [
        (1, datetime(2024, 2, 1, 12), "parcela"), (2, datetime(2024, 2, 1, 8, 30), "parcela"),
        (3, datetime(2024, 2, 1, 8, 30), "parcela"), (4, datetime(2024, 5, 5, 5, 5, 5), "parcela")]
    assert rows(bad, "n") == [(5,), (6,), (7,), (8,), (9,)]


def test_backdated_action_only_wins_by_arrival(spark):
    schema = "user_id string, entity_type string, entity_id string, timestamp timestamp_ntz, tipo_evento string, valor string, message_id int"
    day = lambda d: datetime(2024, 1, d)
    old = act.last_action_state(None, frame(spark, schema, ("u", "parcela", "1", day(10), "abonado", "NPK", 1),
                                            ("u", "parcela", "1", day(9), "riego", None, 2), ("u", "planta", "7", day(9), "riego", None, 3)))
    late = frame(spark, schema, ("u", "parcela", "1", day(3), "abonado", "Urea", 4))
    event = act.last_action_state(old, late)
    arrival = act.last_action_state(old, late, order_by="arrival")
    pick = ("entity_id", "ultimo_riego", "ultimo_abonado", "ultima_poda", "tipo_abono")
    assert rows(event, *pick) == [("1", day(9), day(10), None, "NPK")]
    assert rows(arrival, *pick) == [("1", day(9), day(3), None, "Urea")]


# ---- nesting --------------------------------------------------------------

@pytest.mark.parametrize("n", [1000, 1001, 100_000])
def test_members_of_a_key_stay_rows(spark, n):
    """However many members a key has, equal ones included, each is a row."""
    pairs = spark.range(n).select(F.lit("v").alias("id_victima"), F.col("id").cast("string").alias("id_agresor"), F.lit(1.0).alias("dist_seguridad"))
    places = frame(spark, "id_victima string, id_place string, place_name string, place_coordinates string, radius double", ("v", "z", "Z", "0,0", 5.0))
    out = nesting.relations_by_victim(pairs, places).groupBy("clase").count().collect()
    assert {r["clase"]: r["count"] for r in out} == {"agresor": n, "zona": 1}
    same = spark.range(n).select(F.lit(1).alias("usuario_id"), F.lit("a").alias("nombre"), F.lit("b").alias("cultivo"), F.lit("c").alias("parcela_id"))
    assert nesting.parcel_lines(same).count() == n


def test_last_of_a_repeated_pair_counts(spark):
    pairs = frame(spark, "id_victima string, id_agresor string, dist_seguridad double, n int", ("v", "a", 1.0, 1), ("v", "a", 2.0, 2))
    places = frame(spark, "id_victima string, id_place string, place_name string, place_coordinates string, radius double")
    assert rows(nesting.relations_by_victim(pairs, places, ["n"]), "id_miembro", "dist_seguridad") == [("a", 2.0)]


def test_parcel_lines(spark):
    df = frame(spark, "usuario_id int, nombre string, cultivo string, parcela_id string", (1, "b", None, "p2"), (1, None, "olivo", "p1"))
    assert rows(nesting.parcel_lines(df), "linea") == [("- ? (olivo) → ID: p1",), ("- b (?) → ID: p2",)]


def test_response_stays_finite_at_any_rate(spark):
    """A fast response over a long span: every step is the plain sum."""
    entities = frame(spark, "k int", (1,))
    days = [0.5, 10.0, 425.0, 425.25, 600.0]
    start = datetime(2024, 1, 1)
    events = frame(spark, "k int, ts timestamp_ntz, amp double", *[(1, start + timedelta(days=d), 3.0) for d in days])
    for rate in (0.001, 0.2, 2.0, 900.0):
        got = cx.decayed_response(entities, events, "k", "ts", "amp", rate, "2024-01-01 00:00:00", 700, "1 day").orderBy("ts").collect()
        want = [sum(3.0 * math.exp(-rate * (i - d)) for d in days if d <= i) for i in range(700)]
        assert [r["respuesta"] for r in got] == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_named_fertiliser_does_not_depend_on_the_cut(spark):
    day = lambda d: datetime(2024, 1, d)
    log = frame(
        spark, "user_id string, entity_type string, entity_id string, timestamp timestamp_ntz, tipo_evento string, valor string, message_id long",
        ("u", "parcela", "1", day(1), "abonado", "A", 1), ("u", "parcela", "1", day(5), "abonado", "", 2), ("u", "parcela", "1", day(3), "abonado", "B", 3),
    )
    whole = rows(act.last_action_state(None, log), "tipo_abono", "ultimo_abonado")
    old = act.last_action_state(None, log.filter("message_id < 3"))
    assert rows(act.last_action_state(old, log.filter("message_id = 3")), "tipo_abono", "ultimo_abonado") == whole == [("B", day(5))]
