"""Document quality by a byte-level convolutional network in NumPy.

Every byte has a learned vector. Learned filters slide over chunks of 2 x STEP
bytes that overlap by half and cover the whole document; each filter keeps its
largest value over the chunks, and a logistic layer combines them into one
probability. The filters are applied in two halves, so that no chunk is copied.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .words import in_parts

STEP, WIDTH, FILTERS = 12, 6, 16
PAD = 256  # the symbol behind the end of a document


@dataclass
class Network:
    bytes: np.ndarray  # (257, WIDTH)
    left: np.ndarray  # (STEP * WIDTH, FILTERS)
    right: np.ndarray
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (FILTERS + 1,): weights, then the constant

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        make = lambda *shape, by=1.0: (rng.standard_normal(shape) * by).astype(np.float32)
        scale = 1 / np.sqrt(STEP * WIDTH)
        return cls(make(257, WIDTH, by=0.5), make(STEP * WIDTH, FILTERS, by=scale), make(STEP * WIDTH, FILTERS, by=scale),
                   np.zeros(FILTERS, np.float32), make(FILTERS + 1, by=0.3))

    def parts(self) -> list[np.ndarray]:
        return [self.bytes, self.left, self.right, self.bias, self.out]

    def to_bytes(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, *self.parts())
        return f.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Network:
        with np.load(io.BytesIO(raw)) as f:
            return cls(*(f[f"arr_{i}"] for i in range(5)))

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of the texts in steps, each text with a step of padding behind it, and the first step of each text."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        first = np.concatenate(([0], np.cumsum([-(-len(b) // STEP) + 1 for b in raw])))
        symbols = np.full(first[-1] * STEP, PAD, np.int16)
        for b, at in zip(raw, first, strict=False):
            symbols[at * STEP:at * STEP + len(b)] = np.frombuffer(b, np.uint8)
        return symbols.reshape(-1, STEP), first

    def values(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each filter on each chunk: a step and the next one of the same text."""
        out = np.empty((len(symbols), FILTERS), np.float32)
        for a in range(0, len(symbols), 8192):  # the vectors of a few steps at a time
            vectors = self.bytes[symbols[a:a + 8193]].reshape(-1, STEP * WIDTH)
            n = min(8192, len(symbols) - a)
            out[a:a + n] = vectors[:n] @ self.left
            right = vectors[1:n + 1] @ self.right
            out[a:a + len(right)] += right
        last = first[1:] - 1
        out[last] = self.bytes[symbols[last]].reshape(-1, STEP * WIDTH) @ self.left
        return out

    def combine(self, maxima: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(maxima.astype(np.float64) @ self.out[:-1] + self.out[-1])))

    def scores(self, texts: list[str | None], slice_bytes: int = 1 << 20) -> np.ndarray:
        """Probability per text, for texts of any length, some at a time."""
        out, start, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t or "") + STEP
            if size > slice_bytes or i + 1 == len(texts):
                symbols, first = self.read(texts[start:i + 1])
                top = np.maximum.reduceat(self.values(symbols, first), first[:-1], axis=0)
                out.append(self.combine(np.tanh(top + self.bias)))
                start, size = i + 1, 0
        return np.concatenate(out) if out else np.empty(0)


def train(texts: list[str], labels: np.ndarray, seed: int = 5, rounds: int = 10, rate: float = 0.01, batch: int = 32) -> Network:
    """Adam on the logistic loss; the gradient of a maximum reaches the one chunk that gave it."""
    net = Network.fresh(seed)
    parts = net.parts()
    first_moment, second_moment = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    rng, step = np.random.default_rng(seed), 0
    # Both labels weigh the same.
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels != 1).sum())) * len(labels)
    for _ in range(rounds):
        for chosen in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            symbols, first = net.read([texts[i] for i in chosen])
            values = net.values(symbols, first)
            where = np.stack([a + values[a:b].argmax(axis=0) for a, b in zip(first, first[1:], strict=False)])
            squashed = np.tanh(values[where, np.arange(FILTERS)] + net.bias)
            error = ((net.combine(squashed) - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            d_top = error[:, None] * net.out[:-1] * (1 - squashed ** 2)
            grads = [np.zeros_like(x) for x in parts]
            grads[4][:-1], grads[4][-1] = squashed.T @ error, error.sum()
            grads[3] += d_top.sum(axis=0)
            for f in range(FILTERS):
                left = symbols[where[:, f]]
                right = symbols[np.minimum(where[:, f] + 1, len(symbols) - 1)]
                inner = (where[:, f] + 1 < first[1:])[:, None]
                g = d_top[:, f:f + 1]
                for side, half, on in ((left, 1, True), (right, 2, inner)):
                    use = g * on
                    grads[half][:, f] = (net.bytes[side].reshape(-1, STEP * WIDTH) * use).sum(axis=0)
                    pull = (use * parts[half][:, f]).reshape(-1, STEP, WIDTH)
                    np.add.at(grads[0], side, pull)
            step += 1
            for x, g, m, v in zip(parts, grads, first_moment, second_moment, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)
    return net


def is_held_out(key: Column | str, folds: int = 5, fold: int = 0) -> Column:
    """Whether the CRC-32 of the key as text leaves `fold`; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    per_label: int = 1500, seed: int = 5,
) -> bytes | None:
    """A network from at most `per_label` labelled rows of each label outside the held-out fold, the first by hash.

    The sample's size is bounded by `per_label`, so its keys may be broadcast;
    one task reads its whole texts and returns the network. A key with several
    labels counts as the lower one. None without both labels.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~is_held_out(key))
    known = known.groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("y"))
    order = F.xxhash64(F.lit(seed), "k")
    chosen = known.filter("y = 0").orderBy(order, "k").limit(per_label).unionByName(known.filter("y = 1").orderBy(order, "k").limit(per_label))
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")
    rows = rows.groupBy("k").agg(F.min("text").alias("text"), F.min("y").alias("y"))

    def learn(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("k")
        y = sample["y"].to_numpy()
        if len(set(y)) < 2:
            return pd.DataFrame({"network": [b""]})
        return pd.DataFrame({"network": [train([t or "" for t in sample["text"]], y, seed).to_bytes()]})

    found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(lambda sample: learn(sample), "network binary").collect()
    return bytes(found[0][0]) if found and found[0][0] else None


def score(
    df: DataFrame, network: bytes | None, key: str = "doc_id", text: str = "text", threshold: float = 0.3, out: str = "score",
) -> DataFrame:
    """All columns of `df`, a score (probability of label 1) and `predicted` (score >= threshold).

    Whole texts of any length; null counts as empty. Without a network (no
    labels) every score is 0.5. Columns with the new names are replaced.
    """
    kept = [c for c in df.columns if c not in (out, "predicted")]
    rows = df.select(*["`" + c.replace("`", "``") + "`" for c in kept])
    schema = StructType(list(rows.schema.fields)).add(out, "double").add("predicted", "integer")

    def run(batches):
        net = Network.from_bytes(network) if network else None
        for batch in in_parts(batches, kept.index(text)):
            texts = batch.column(kept.index(text)).to_pylist()
            p = np.full(len(texts), 0.5) if net is None else net.scores(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[*kept, out, "predicted"])

    return rows.mapInArrow(run, schema)
