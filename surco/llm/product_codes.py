"""Near-duplicate vectors by product quantisation.

A coarse quantiser deals vectors into inverted lists; the residual to the list's
centre is coded per subspace. A vector probes every list that can hold a partner
at the threshold: the plane between two centres bounds the distance, so probes
are sufficient, not guessed. Table look-ups give the distance to the coded
vector; the triangle inequality with the stored coding error drops a pair only
when it cannot reach the threshold. What is left is confirmed by exact cosine.

Equal vectors of a label are one class. The quantiser is fitted on a bounded
sample; it decides the speed, never the result.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import components, kept
from .vectors import distances, kmeans, matrix, sample, usable

# Vectors of a list, and vectors that probe it, in one task.
TILE, CHUNK = 1024, 4096
SLACK = 1e-6


@dataclass
class Quantiser:
    centres: np.ndarray
    books: list[np.ndarray]  # of each subspace
    cuts: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, spaces: int, codes: int, seed: int) -> Quantiser:
        centres = kmeans(x, lists, seed)
        rest = x - centres[distances(x, centres).argmin(axis=1)]
        cuts = np.linspace(0, x.shape[1], min(spaces, x.shape[1]) + 1).astype(int)
        return cls(centres, [kmeans(rest[:, a:b], codes, seed + i) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))], cuts)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of each row."""
        place = distances(x, self.centres).argmin(axis=1)
        rest = x - self.centres[place]
        codes = np.stack([distances(rest[:, a:b], book).argmin(axis=1) for a, b, book in self.spaces()], axis=1).astype(np.uint8)
        back = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)
        return place, codes, np.sqrt(((rest - back) ** 2).sum(axis=1))

    def spaces(self):
        return [(a, b, book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]

    def probes(self, x: np.ndarray, place: np.ndarray, reach: float) -> np.ndarray:
        """Which lists can hold a vector within `reach`: the plane between the centres is no farther."""
        d = distances(x, self.centres)
        own = d[np.arange(len(x)), place]
        apart = np.sqrt(distances(self.centres, self.centres))[place]
        beyond = (d - own[:, None]) / np.maximum(2 * apart, 1e-12)
        out = beyond <= reach + SLACK
        out[np.arange(len(x)), place] = True
        return out

    def asymmetric(self, x: np.ndarray, place: int, codes: np.ndarray) -> np.ndarray:
        """Distances of rows of `x` to the coded vectors of one list, by look-up."""
        rest = x - self.centres[place]
        total = np.zeros((len(x), len(codes)))
        for i, (a, b, book) in enumerate(self.spaces()):
            total += distances(rest[:, a:b], book)[:, codes[:, i]]
        return np.sqrt(total)


def linked(x: np.ndarray, y: np.ndarray, q: Quantiser, place: int, codes: np.ndarray, error: np.ndarray, reach: float, threshold: float) -> np.ndarray:
    """Exact links between rows of x and vectors y of a list: codes first, cosine for what they leave."""
    out = np.zeros((len(x), len(y)), bool)
    for a in range(0, len(x), 256):
        can = q.asymmetric(x[a:a + 256], place, codes) - error <= reach + SLACK
        i, j = np.nonzero(can)
        for s in range(0, len(i), 65536):
            ii, jj = i[s:s + 65536], j[s:s + 65536]
            good = np.einsum("ij,ij->i", x[a + ii], y[jj]) >= threshold
            out[a + ii[good], jj[good]] = True
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs, at most one per row and column, that connect what the links connect."""
    label = np.arange(links.shape[1])
    out = []
    for i in np.flatnonzero(links.any(axis=1)):
        columns = np.flatnonzero(links[i])
        seen, first = np.unique(label[columns], return_index=True)
        out.extend((int(i), int(columns[f])) for f in first)
        if len(seen) > 1:
            label[np.isin(label, seen)] = seen[0]
    return out


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93,
    lists: int = 32, spaces: int = 8, codes: int = 64, fitted_on: int = 4096, seed: int = 3,
) -> DataFrame:
    """One row per row of `df`: key, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null, their lengths are
    equal and the cosine in doubles is `threshold` or more. `n_links` counts the
    other rows linked directly. `component_id` is the least key that links reach,
    the row's own included. Rows without label or usable vector link with
    nothing; without a key they take part, and their `component_id` is the least
    key of their component, null if there is none. Rows with one key count as
    rows of their own.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    valid = usable(df.filter(F.col(label).isNotNull()), key, vector, label)
    quantisers = {d: Quantiser.fit(x, lists, spaces, codes, seed) for d, x in sample(valid, fitted_on, seed).items()}
    model = pickle.dumps(quantisers)
    kind = dict(valid.dtypes)["label"]
    classes = valid.groupBy("label", "dim", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("least"), F.first("vector").alias("vector"))
    classes = classes.withColumn("node", F.xxhash64("label", "dim", "digest"))

    def place(batches):
        known = pickle.loads(model)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                q = known.get(int(d))
                if q is None:  # a length that the sample missed: one list, centred at nothing
                    q = Quantiser(np.zeros((1, d)), [np.zeros((1, d))], np.array([0, d]))
                x = matrix(part.column("vector"))
                at, code, error = q.encode(x)
                probed = q.probes(x, at, reach)
                # Of two lists the one of the lower number probes the other.
                targets = [np.flatnonzero(row[p:]) + p for row, p in zip(probed, at, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column("label"), part.column("dim"), part.column("node"), part.column("copies"), part.column("vector"),
                    pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error),
                    pa.array([t.astype(np.int32) for t in targets], pa.list_(pa.int32())),
                ], names=["label", "dim", "node", "copies", "vector", "list", "codes", "error", "probes"])

    placed = kept(classes.select("label", "dim", "node", "copies", "vector").mapInArrow(
        place, f"label {kind}, dim int, node long, copies long, vector binary, list int, codes binary, error double, probes array<int>"))
    sizes = placed.groupBy("label", "dim", "list").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    chunks = placed.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    whole = ["label", "dim"]
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = placed.join(chunks, whole)
    held = rows.join(sizes, [*whole, "list"]).withColumn("tile", F.pmod(F.xxhash64("node", F.lit(1)), "tiles").cast("int")).withColumn("chunk", spread("chunks"))
    asking = rows.withColumn("target", F.explode("probes")).join(
        sizes.withColumnRenamed("list", "target"), [*whole, "target"])
    asking = asking.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(2)), "chunks").cast("int")).withColumn("tile", spread("tiles"))
    group = [*whole, "list", "tile", "chunk"]
    held = held.select(*group, "node", "copies", "vector", "codes", "error")
    asking = asking.select(*whole, F.col("target").alias("list"), "tile", "chunk", "node", "copies", "vector", F.col("list").alias("from_list"))
    asking = asking.toDF(*asking.columns)  # columns of its own beside those of `held`

    def compare(ask: pa.Table, hold: pa.Table) -> pa.Table:
        out: dict[str, list] = {"node": [], "other": [], "links": []}
        if len(ask) and len(hold):
            d, at = hold.column("dim")[0].as_py(), hold.column("list")[0].as_py()
            q = pickle.loads(model).get(d) or Quantiser(np.zeros((1, d)), [np.zeros((1, d))], np.array([0, d]))
            x, y = matrix(ask.column("vector")), matrix(hold.column("vector"))
            code = np.frombuffer(b"".join(hold.column("codes").to_pylist()), np.uint8).reshape(len(y), -1)
            links = linked(x, y, q, at, code, hold.column("error").to_numpy(), reach, threshold)
            a, b = ask.column("node").to_numpy(), hold.column("node").to_numpy()
            same = ask.column("from_list").to_numpy() == at
            links &= ~same[:, None] | (a[:, None] < b)  # within a list, each pair once
            for nodes, counts in ((a, links @ hold.column("copies").to_numpy()), (b, ask.column("copies").to_numpy() @ links)):
                got = np.flatnonzero(counts)
                out["node"] += nodes[got].tolist()
                out["other"] += [None] * len(got)
                out["links"] += counts[got].tolist()
            for i, j in forest(links):
                out["node"].append(int(a[i]))
                out["other"].append(int(b[j]))
                out["links"].append(0)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    found = kept(asking.groupBy(*group).cogroup(held.groupBy(*group)).applyInArrow(compare, "node long, other long, links long"))
    comps = components(found.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    counts = found.filter("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    nodes = classes.select("node", "copies", "least").join(comps, "node", "left").join(counts, "node", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "component").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    members = valid.select(F.col("key").alias("k"), F.xxhash64("label", "dim", "digest").alias("node")).join(nodes, "node")
    alone = _unlinked(df, key, vector, label)
    out = members.select(F.col("k").alias(key), "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _unlinked(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """The rows that link with nothing, by the same tests as `usable`, in SQL."""
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = F.col(label).isNull() | v.isNull() | (F.size(v) == 0) | F.exists(v, bad) | ~F.exists(v, lambda x: x != 0)
    rows = df.filter(F.coalesce(out, F.lit(True)))
    return rows.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"))
