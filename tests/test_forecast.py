"""The closed-form forecast: exact on series without noise, the same as a plain fit on others, cut by cut."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from surco.operators import forecast as fc

FIRST = date(2015, 3, 1)
TARGETS = {"et0": ("et0_mm", "multiplicative", False), "precip": ("precipitacion_mm", "additive", True)}


def truth(day: date, grown: bool) -> float:
    d = (day - date(1970, 1, 1)).days
    t, w = (d - fc.DAY_ZERO) / fc.YEAR, 2 * np.pi * d / fc.YEAR
    season = 0.8 * np.cos(w) - 0.3 * np.sin(2 * w) + 0.1 * np.cos(3 * w)
    return float(5 + 0.1 * t + season * (1 + 0.05 * t if grown else 1))


def series(spark, rows):
    return spark.createDataFrame(rows, "parcela_id string, target string, ds date, y double")


def test_series_without_noise_come_back(spark):
    rows = []
    for i in range(1500):
        day = FIRST + timedelta(days=i)
        rows += [("a", "et0", day, truth(day, True)), ("a", "precip", day, float(np.expm1(truth(day, False) / 4)))]
    out = fc.moment_forecast(series(spark, rows).repartition(7), 20, targets=TARGETS).collect()
    assert len(out) == 40
    for r in out:
        want = truth(r.fecha, True) if r.target == "et0" else np.expm1(truth(r.fecha, False) / 4)
        assert r.p50 == pytest.approx(want, abs=0.011) and r.p25 == pytest.approx(r.p50, abs=0.011) and r.p75 == pytest.approx(r.p50, abs=0.011)
        assert FIRST + timedelta(days=1500) <= r.fecha < FIRST + timedelta(days=1520)


def noisy(seed, n=2400, gap=(0, 0)):
    rng = np.random.default_rng(seed)
    days = [FIRST + timedelta(days=int(i)) for i in range(n) if not gap[0] <= i < gap[1]]
    return [(f"s{seed}", t, d, float(max(0.0, truth(d, True) + rng.normal()))) for d in days for t in TARGETS if rng.random() < 0.9]


def plain(rows, target, cutoff, ahead):
    mode, log = TARGETS[target][1:]
    past = [(d, y) for _, t, d, y in rows if t == target and d <= cutoff]
    days = np.array([(d - date(1970, 1, 1)).days for d, _ in past], float)
    y = np.array([v for _, v in past])
    y = np.log1p(y) if log else y
    x = fc.features(days, mode)
    beta = np.linalg.solve(x.T @ x + fc.RIDGE * np.eye(x.shape[1]), x.T @ y)
    spread = np.sqrt(((y - x @ beta) ** 2).mean())
    middle = fc.features(np.array([float((a - date(1970, 1, 1)).days) for a in ahead]), mode) @ beta
    return middle, spread * fc.QUARTILE


def test_every_cutoff_is_a_fit_of_the_days_before_it(spark):
    """Two series, one with a gap longer than a period: the cutoff in the gap is there and uses what lies before."""
    groups = {1: noisy(1), 2: noisy(2, gap=(2150, 2260))}
    df = series(spark, [r for g in groups.values() for r in g]).repartition(5)
    got = fc.moment_walk_forward(df, initial=1825, period=90, horizon=14).collect()
    asked = {(r.parcela_id, r.target, r.corte, r.ds) for r in fc.walk_forward_rows(df).collect()}
    assert {(r.parcela_id, r.target, r.corte, r.ds) for r in got} == asked and len(got) == len(asked)
    for seed, rows in groups.items():
        for target in TARGETS:
            known = {d: y for _, t, d, y in rows if t == target}
            last, cut = max(known) - timedelta(days=14), max(known) - timedelta(days=14)
            want = {}
            while (cut - min(known)).days >= 1825:
                ahead = [cut + timedelta(days=h) for h in range(1, 15) if cut + timedelta(days=h) in known]
                if ahead:
                    middle, half = plain(rows, target, cut, ahead)
                    want |= {(cut, d): (m, m - half, m + half) for d, m in zip(ahead, middle)}
                cut -= timedelta(days=90)
            mine = {(r.corte, r.ds): r for r in got if r.parcela_id == f"s{seed}" and r.target == target}
            assert set(mine) == set(want) and len({c for c, _ in want}) >= 5 and last in {c for c, _ in want}
            for k, r in mine.items():
                assert (r.yhat, r.yhat_lower, r.yhat_upper) == pytest.approx(want[k], abs=1e-6)
                assert r.horizonte == (k[1] - k[0]).days
                assert r.y == pytest.approx(np.log1p(known[k[1]]) if target == "precip" else known[k[1]])


def test_moments_add_up(spark):
    """The same sums from one partition and from many, and from two halves."""
    df = series(spark, noisy(3))
    def told(d):
        return {(r.target, r.slot): r.total for r in d.collect()}
    whole = told(fc.moments(df.coalesce(1), ("parcela_id",)))
    many = told(fc.moments(df.repartition(9), ("parcela_id",)))
    early, late = (told(fc.moments(df.filter(c), ("parcela_id",))) for c in (F.col("ds") < "2018-01-01", F.col("ds") >= "2018-01-01"))
    assert set(whole) == set(many) == set(early)
    for k, v in whole.items():
        assert many[k] == pytest.approx(v, rel=1e-9, abs=1e-9) and early[k] + late[k] == pytest.approx(v, rel=1e-9, abs=1e-9)


def test_short_and_empty_series(spark):
    few = series(spark, [("x", "et0", FIRST, 3.0), ("x", "et0", FIRST + timedelta(days=1), 3.0)])
    out = fc.moment_forecast(few, 3, targets=TARGETS).orderBy("fecha").collect()
    assert [r.p50 for r in out] == pytest.approx([3.0] * 3, abs=0.1)  # nothing but the ridge decides between slope and waves
    assert fc.moment_forecast(few.limit(0)).count() == 0 and fc.moment_walk_forward(few).count() == 0
