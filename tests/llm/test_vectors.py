"""Operators on vectors against all pairs."""

import collections

import numpy as np
import pytest

from surco.llm import curves, links, product_codes
from surco.llm.curves import hilbert
from surco.llm.vectors import units

SCHEMA = "vec_id long, embedding array<float>, label int, node string, list int, score string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, "s") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((120, 16))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    for i in range(80):  # a hot group of near copies, spread so that some only link through others
        rows.append((200 + i, (base[0] + rng.standard_normal(16) * rng.choice([0.05, 0.25, 0.4])).tolist(), 0))
    rows += [(400 + i, base[1].tolist(), 1) for i in range(40)]  # equal vectors
    rows += [(500, (base[2] * 7).tolist(), 2), (501, base[2].tolist(), None), (502, None, 1), (503, [0.0] * 16, 1), (504, [float("nan")] + [1.0] * 15, 1),
             (505, [None] + [1.0] * 15, 1), (506, [], 1), (507, [1.0, 2.0], 1), (508, [1.0, 2.0], 1), (509, [1e30] * 16, 0), (510, [1e-30] * 16, 0),
             (511, [float("inf")] * 16, 0), (400, base[1].tolist(), 1)]
    return [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for k, v, label in rows]


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def unit(v):
    v = np.array(v, float) / max(abs(x) for x in v)
    return v / np.linalg.norm(v)


def linked_pairs(vectors, threshold):
    for i, (_, v, a) in enumerate(vectors):
        for j, (_, w, b) in enumerate(vectors[:i]):
            if a is not None and a == b and usable(v) and usable(w) and len(v) == len(w) and unit(v) @ unit(w) >= threshold:
                yield i, j


@pytest.mark.parametrize("tile", [1024, 8])
def test_near_vectors(spark, vectors, tile, monkeypatch):
    monkeypatch.setattr(product_codes, "TILE", tile)
    monkeypatch.setattr(product_codes, "CHUNK", 4 * tile)
    degree, group = collections.Counter(), list(range(len(vectors)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in linked_pairs(vectors, 0.93):
        degree[i] += 1
        degree[j] += 1
        group[root(i)] = root(j)
    least = {}
    for i, (k, _, _) in enumerate(vectors):
        least[root(i)] = min(k, least.get(root(i), k))
    want = sorted((k, degree[i], least[root(i)], k == least[root(i)]) for i, (k, _, _) in enumerate(vectors))
    got = product_codes.near_duplicates(table(spark, vectors), lists=6, codes=8, fitted_on=100)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_near_vectors_of_nothing(spark):
    empty = table(spark, [])
    assert product_codes.near_duplicates(empty).count() == 0
    assert curves.nearest(empty, empty).count() == 0


def test_codes_never_lose_a_pair():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 12))
    x[200:] = x[:200] + 0.15 * rng.standard_normal((200, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = product_codes.Quantiser.fit(x, 10, 4, 16, 1)
    place, codes, error = q.encode(x)
    reach = np.sqrt(2 - 2 * 0.93)
    probes = q.probes(x, place, reach)
    for i, j in zip(*np.nonzero(x @ x.T >= 0.93)):
        assert probes[i, place[j]]
        assert q.asymmetric(x[i:i + 1], place[j], codes[j:j + 1])[0, 0] - error[j] <= reach + 1e-6


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(9)
    for _ in range(50):
        m = rng.random((12, 9)) < 0.12

        def groups(pairs):
            parent = list(range(21))

            def root(i):
                while parent[i] != i:
                    i = parent[i]
                return i

            for i, j in pairs:
                parent[root(i)] = root(12 + j)
            return [root(i) for i in range(21)]

        a, b = groups(zip(*np.nonzero(m))), groups(product_codes.forest(m))
        assert len({*zip(a, b)}) == len(set(a)) == len(set(b))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(50)] + [(300, 301), (301, 300), (302, 302), (None, 5)]
    got = {r["node"]: r["component"] for r in links.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {300: 300, 301: 300}
    assert got == want


@pytest.mark.parametrize("tile", [4096, 16])
def test_nearest(spark, vectors, tile, monkeypatch):
    monkeypatch.setattr(curves, "TILE", tile)
    monkeypatch.setattr(curves, "CHUNK", tile)
    rows = table(spark, vectors)
    got = collections.defaultdict(list)
    for r in curves.nearest(rows, rows.filter("vec_id % 50 = 0"), ranges=8, fitted_on=60).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for k, v, _ in vectors:
        if k % 50 == 0 and usable(v):
            near = sorted((-min(1.0, float(unit(v) @ unit(w))), c) for c, w, _ in vectors if c != k and usable(w) and len(w) == len(v))[:5]
            want[k] = near
    assert got.keys() == want.keys()
    for k, near in want.items():
        assert [r for r, _, _ in got[k]] == [1, 2, 3, 4, 5]
        assert [s for _, _, s in got[k]] == pytest.approx([-s for s, _ in near], abs=1e-12)
        loose = {c for s, c in near}
        assert {c for _, c, _ in got[k]} == loose or len({round(s, 9) for s, _ in near}) < 5


def test_ties_go_to_the_smaller_key(spark):
    """Groups of equal vectors larger than k: of equal scores the smaller keys, whatever the last bit of a matrix product."""
    rng, n = np.random.default_rng(1021), 1021
    base = rng.standard_normal((n, 128)).astype(np.float32)
    base[rng.permutation(n)[:n // 3]] = base[rng.integers(0, 6, n // 3)]
    rows = table(spark, [(i, v.tolist(), 0) for i, v in enumerate(base)])
    got = collections.defaultdict(list)
    for r in curves.nearest(rows, rows.filter("vec_id < 203"), ranges=1).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    x = units(base.astype(float))
    for q in range(203):
        score = np.clip((x * x[q]).sum(axis=1), -1, 1)
        assert got[q] == [i for i in np.lexsort((np.arange(n), -score)) if i != q][:5]


def test_few_candidates(spark, vectors):
    rows = table(spark, vectors[:3])
    got = curves.nearest(rows, rows.filter("vec_id = 0")).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got)[0][0] == 1 and len(got) == 2


@pytest.mark.parametrize("axes,depth", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_neighbours(axes, depth):
    cells = np.stack(np.meshgrid(*[np.arange(1 << depth)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = hilbert(cells, depth)
    order = np.argsort(keys)
    assert keys[order].tolist() == list(range(len(cells)))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_a_round_of_stars_keeps_its_plan_small(spark):
    """Two rounds stand in one plan, which the driver holds whole: a side used twice may not double it at every step."""
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8)], "u long, v long").localCheckpoint()
    twice = links.stars(links.stars(edges))
    text = twice._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LogicalRDD") <= 16 and "Union" not in text
    assert sorted(map(tuple, twice.collect())) == [(2, 1), (3, 1), (4, 1), (9, 8)]
