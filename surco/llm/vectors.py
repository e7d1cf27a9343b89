"""Vectors as packed binary columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str, label: str | None = None) -> DataFrame:
    """Rows `key, label, dim, digest, vector` of the vectors that have a direction.

    Left out: null and empty vectors, those with null or non-finite components,
    and zero vectors. `vector` is packed doubles as given; `digest` is theirs.
    """
    columns = [F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")]
    if label:
        columns.append(F.col(label).alias("label"))
    rows = df.select(*columns)
    kinds = dict(rows.dtypes)
    schema = f"key {kinds['key']}, {'label ' + kinds['label'] + ', ' if label else ''}dim int, digest binary, vector binary"

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            good, dims, digests, packed = [], [], [], []
            for i, v in enumerate(column):
                if not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False) + 0.0  # one zero only
                if not np.isfinite(x).all() or not x.any():
                    continue
                good.append(i)
                dims.append(len(x))
                packed.append(x.tobytes())
                digests.append(hashlib.md5(packed[-1]).digest())
            take = pa.array(good, pa.int64())
            kept = [batch.column(c).take(take) for c in ([0, 2] if label else [0])]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())],
                names=["key", *(["label"] if label else []), "dim", "digest", "vector"])

    return rows.mapInArrow(run, schema)


def matrix(column: pa.ChunkedArray | pa.Array, unit: bool = True) -> np.ndarray:
    """Packed vectors of one dimension as rows, of length one if asked for."""
    rows = column.to_pylist()
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    return units(x) if unit else x


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small values stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sample(rows: DataFrame, most: int, seed: int) -> dict[int, np.ndarray]:
    """At most `most` unit vectors, the first by hash of their digest, by dimension."""
    order = F.xxhash64(F.lit(seed), "digest")
    found: dict[int, list[bytes]] = {}
    for r in rows.select("dim", "digest", "vector").orderBy(order, "digest").limit(most).select("dim", "vector").collect():
        found.setdefault(r["dim"], []).append(bytes(r["vector"]))
    return {d: units(np.frombuffer(b"".join(v), np.float64).reshape(len(v), d)) for d, v in found.items()}


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centres of at most `k` groups; empty ones keep their last place."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T)
