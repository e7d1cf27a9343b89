"""Nearest neighbours along shifted space-filling curves.

Vectors are projected to a few dimensions, and several shifted Hilbert curves
order the projections. Each order is cut into ranges by splitters, a range into
tiles of bounded size. A query looks at the ranges around its own key on every
curve; the windows merge and rerank by exact cosine. On the first curve the
window then widens to every range whose cone can hold a nearer vector than the
fifth found, so no nearer vector is missed, however the data lie.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .links import kept
from .vectors import matrix, sample, units, usable

CURVES, AXES, DEPTH = 4, 6, 8
# Vectors and queries of a range in one task.
TILE, CHUNK = 4096, 4096
SLACK = 1e-9
# By how much the matrix product of two unit vectors may miss their exact score, twice: its last bits depend on the place in the matrix.
LAST_BITS = 1e-12


def hilbert(cells: np.ndarray, depth: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cell numbers, of `depth` bits per axis."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    level = np.uint64(1) << np.uint64(depth - 1)
    bit = level
    while bit > 1:  # undo the turns and mirrors of the finer levels
        low = bit - np.uint64(1)
        for i in range(n):
            mirrored = (x[i] & bit) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(mirrored, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(mirrored, x[i], x[i] ^ swap)
        bit >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = level
    while bit > 1:
        turn = np.where((x[n - 1] & bit) != 0, turn ^ (bit - np.uint64(1)), turn)
        bit >>= np.uint64(1)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for i in range(n):
            key = key << np.uint64(1) | (x[i] >> np.uint64(b)) & np.uint64(1)
    return key.astype(np.int64)


@dataclass
class Curves:
    """Projection, shift and splitters of each curve, for vectors of one length."""

    axes: list[np.ndarray]
    shifts: np.ndarray
    low: np.ndarray
    scale: np.ndarray
    splitters: list[np.ndarray]
    centres: np.ndarray  # a direction for every range of the first curve

    @classmethod
    def fit(cls, x: np.ndarray, ranges: int, seed: int) -> Curves:
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        axes = [np.linalg.qr(rng.standard_normal((d, min(d, AXES))))[0] for _ in range(CURVES)]
        shifts = rng.random((CURVES, min(d, AXES)))
        seen = [x @ a for a in axes]
        low = np.array([p.min(axis=0) for p in seen])
        scale = (1 << (DEPTH - 1)) / np.maximum(np.array([p.max(axis=0) for p in seen]) - low, 1e-12)
        out = cls(axes, shifts, low, scale, [], np.empty(0))
        for c in range(CURVES):
            keys = np.sort(out.keys(x, c))
            out.splitters.append(np.unique(keys[np.linspace(0, len(keys), ranges + 1).astype(int)[1:-1]]))
        out.centres = np.full((len(out.splitters[0]) + 1, d), 1.0)
        np.add.at(out.centres, out.ranges(x, 0), x * len(x))
        out.centres = units(out.centres)
        return out

    def keys(self, x: np.ndarray, c: int) -> np.ndarray:
        cells = (x @ self.axes[c] - self.low[c]) * self.scale[c] + self.shifts[c] * (1 << (DEPTH - 1))
        return hilbert(np.clip(cells, 0, (1 << DEPTH) - 1), DEPTH)

    def ranges(self, x: np.ndarray, c: int) -> np.ndarray:
        return np.searchsorted(self.splitters[c], self.keys(x, c), side="right")


def nearest(
    df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5,
    ranges: int = 64, around: int = 1, fitted_on: int = 8192, seed: int = 9,
) -> DataFrame:
    """`query_id, rank, <key>, score`: the k rows of `df` with the largest cosine for each row of `queries`.

    A query's own key is no candidate. Ties go to the smaller key; equal rows that
    repeat a key are candidates of their own; a query key that is repeated counts
    once for each distinct vector. Vectors that are null, empty, zero or hold null or
    non-finite components, rows without a key, and rows of another length than the
    query take no part. Curves and splitters are fitted on at most `fitted_on` rows;
    every row is indexed, and the result does not depend on the sample.
    """
    valid = usable(df, key, vector).filter(F.col("key").isNotNull())
    asked = usable(queries, key, vector).filter(F.col("key").isNotNull()).dropDuplicates(["key", "digest"])
    fitted = {d: Curves.fit(x, ranges, seed) for d, x in sample(valid, fitted_on, seed).items()}
    model = pickle.dumps(fitted)
    kind = dict(valid.dtypes)["key"]

    def lay(batches, curves):
        """Rows of each curve with the range of the vector."""
        known = pickle.loads(model)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = matrix(part.column("vector"))
                for c in curves:
                    at = known[int(d)].ranges(x, c) if int(d) in known else np.zeros(len(x), np.int64)  # a length that the sample missed is one range
                    yield pa.RecordBatch.from_arrays([
                        part.column("dim"), pa.array(np.full(len(x), c, np.int32)), pa.array(at.astype(np.int32)), part.column("key"), part.column("vector"),
                    ], names=["dim", "curve", "range", "key", "vector"])

    laid = f"dim int, curve int, range int, key {kind}, vector binary"
    place = ["dim", "curve", "range"]
    rows = kept(valid.mapInArrow(lambda b: lay(b, range(CURVES)), laid))
    tiles = rows.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    own = asked.mapInArrow(lambda b: lay(b, range(CURVES)), laid)
    window = own.withColumn("range", F.explode(F.sequence(F.col("range") - around, F.col("range") + around)))
    first = _search(rows, window, tiles, place, kind, k)
    # What the windows found bounds how far the first curve has to be followed.
    merged = _merge(first, k)
    bound = merged.filter(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("query").alias("qv"), F.col("score").alias("least"))
    cones = _cones(rows.filter("curve = 0"), fitted)
    ask = own.filter("curve = 0").select("dim", "key", "vector")
    ask = ask.join(bound, (F.col("key") == F.col("q")) & (F.md5("vector") == F.col("qv")), "left").select("dim", "key", "vector", "least")

    def widen(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                if int(d) not in cones:
                    continue
                numbers, centres, angles = cones[int(d)]
                x = matrix(part.column("vector"))
                least = np.array([-1.0 if v is None else v for v in part.column("least").to_pylist()])
                # The nearest a vector of the cone can come to the query.
                gap = np.maximum(0, np.arccos(np.clip(x @ centres.T, -1, 1)) - angles)
                i, j = np.nonzero(np.cos(gap) >= least[:, None] - SLACK)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([
                    part.column("dim").take(take), pa.array(np.zeros(len(i), np.int32)), pa.array(numbers[j].astype(np.int32)),
                    part.column("key").take(take), part.column("vector").take(take)], names=["dim", "curve", "range", "key", "vector"])

    wide = ask.mapInArrow(widen, laid)
    second = _search(rows.filter("curve = 0"), wide, tiles, place, kind, k)
    best = _merge(first.filter("curve <> 0").unionByName(second), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")


def _search(rows: DataFrame, asked: DataFrame, tiles: DataFrame, place: list[str], kind: str, k: int) -> DataFrame:
    """The k best of each tile for every query that looks at its range."""
    chunks = asked.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = tiles.join(chunks, place)
    group = [*place, "tile", "chunk"]
    hold = rows.join(both, place).withColumn("tile", F.pmod(F.xxhash64("key", "vector"), "tiles").cast("int")).withColumn("chunk", spread("chunks"))
    ask = asked.join(both, place).withColumn("chunk", F.pmod(F.xxhash64("key", "vector"), "chunks").cast("int")).withColumn("tile", spread("tiles"))
    hold, ask = (x.select(*group, "key", "vector") for x in (hold, ask))
    ask = ask.toDF(*ask.columns)

    def look(q: pa.Table, y: pa.Table) -> pa.Table:
        out: dict[str, list] = {"curve": [], "query_id": [], "query": [], "key": [], "score": []}
        if len(q) and len(y):
            at, own = matrix(y.column("vector")), matrix(q.column("vector"))
            keys, asks = y.column("key").to_numpy(), q.column("key").to_numpy()
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            names = [hashlib.md5(v).hexdigest() for v in q.column("vector").to_pylist()]
            curve = q.column("curve")[0].as_py()
            for a in range(0, len(own), 256):
                cosine = own[a:a + 256] @ at.T
                cosine[asks[a:a + 256, None] == keys] = -2
                for i, row in enumerate(cosine):
                    some = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, -k)[-k] - LAST_BITS)
                    some = some[row[some] > -1.5]
                    score = np.clip((at[some] * own[a + i]).sum(axis=1), -1, 1)
                    best = np.argsort(-score, kind="stable")[:k]  # rows are in order of key
                    some, score = some[best], score[best]
                    out["curve"] += [curve] * len(some)
                    out["query_id"] += [asks[a + i]] * len(some)
                    out["query"] += [names[a + i]] * len(some)
                    out["key"] += keys[some].tolist()
                    out["score"] += score.tolist()
        types = {"curve": pa.int32(), "query_id": y.schema.field("key").type, "query": pa.string(), "key": y.schema.field("key").type, "score": pa.float64()}
        return pa.table({c: pa.array(v, types[c]) for c, v in out.items()})

    schema = f"curve int, query_id {kind}, query string, key {kind}, score double"
    return ask.groupBy(*group).cogroup(hold.groupBy(*group)).applyInArrow(look, schema)


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of all windows; a row that several curves found counts once, one that is there several times as often."""
    times = found.groupBy("curve", "query_id", "query", "key", "score").agg(F.count(F.lit(1)).alias("n"))
    once = times.groupBy("query_id", "query", "key", "score").agg(F.max("n").alias("n"))
    copies = once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "key")
    return copies.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _cones(rows: DataFrame, fitted: dict[int, Curves]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Every range of the first curve, its direction, and the widest angle to it: as many rows as there are ranges."""
    model = pickle.dumps({d: c.centres for d, c in fitted.items()})

    def widest(batches):
        centres = pickle.loads(model)
        for batch in batches:
            key = np.stack([batch.column("dim").to_numpy(), batch.column("range").to_numpy()], axis=1)
            for d, r in np.unique(key, axis=0):
                part = batch.filter(pa.array((key == (d, r)).all(axis=1)))
                cosine = matrix(part.column("vector")) @ centres[int(d)][r] if int(d) in centres else np.array([-1.0])
                yield pa.RecordBatch.from_arrays([
                    pa.array([d], pa.int32()), pa.array([r], pa.int32()), pa.array([float(np.arccos(np.clip(cosine.min(), -1, 1)))])],
                    names=["dim", "range", "angle"])

    angles = rows.select("dim", "range", "vector").mapInArrow(widest, "dim int, range int, angle double")
    out: dict[int, list] = {}
    for r in angles.groupBy("dim", "range").agg(F.max("angle").alias("angle")).collect():
        centre = fitted[r["dim"]].centres[r["range"]] if r["dim"] in fitted else np.eye(1, r["dim"])[0]
        out.setdefault(r["dim"], []).append((r["range"], centre, r["angle"]))
    return {d: (np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.array([x[2] for x in v])) for d, v in out.items()}
