"""Words of many texts at once, as 64-bit hashes in NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The code points that separate words.
SPACES = b" \t\n\x0b\x0c\r"
# The words of a text, in the pattern syntax of the JVM.
WORD = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that near values are far apart."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Rows from and to, of `most` bytes of text together, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    sums = np.cumsum(sizes, dtype=np.int64)
    a = 0
    while a < len(sizes):
        done = int(sums[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(sums, done + most, side="right")))
        yield a, b
        a = b


def in_parts(batches: Iterable[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches with `most` bytes of text at a time, or one longer text; what Arrow held goes back at the end."""
    for batch in batches:
        for a, b in slices(batch.column(column), most):
            yield batch.slice(a, b - a)
        del batch
    pa.default_memory_pool().release_unused()


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_IN_WORD = Powers(_BASE)
_IN_WINDOW = Powers(0xDA942042E4DD58B5)


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of `width` values: sum of value times power, shifted to one place."""
    n = max(0, len(values) - width + 1)
    out = np.empty(n, np.uint64)
    for a in range(0, n, _CHUNK):  # chunk after chunk, so that the tables stay small
        part = values[a:min(a + _CHUNK, n) + width - 1]
        up, down = _IN_WINDOW.upto(len(part))
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * up, out=sums[1:])
        here = len(part) - width + 1
        out[a:a + here] = mix((sums[width:] - sums[:here]) * down[:here])
    return out


class Words:
    """The words of some texts: one hash each, and where each text's words begin and end.

    Nulls and texts without words have none. `lower` folds A to Z.
    """

    def __init__(self, texts: Sequence[str | None], lower: bool = False):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        del raw
        if lower:
            data = _LOWER[data]
        space = _IS_SPACE[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0] = len(data) > 0 and not space[0]
        edge[1:-1] = space[1:] != space[:-1]
        edge[-1] = len(data) > 0 and not space[-1]
        cuts = np.flatnonzero(edge)
        self.data, self.starts, self.ends = data, cuts[::2], cuts[1::2]
        firsts = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.offsets = np.searchsorted(self.starts, firsts)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        """Chunk after chunk of whole words, so that the tables stay small."""
        out = np.empty(len(self.starts), np.uint64)
        a = 0
        while a < len(out):
            low = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, low + _CHUNK, side="right")))
            part = _BYTE[self.data[low:self.ends[b - 1]]]
            up, down = _IN_WORD.upto(len(part))
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(part * up, out=sums[1:])
            s, e = self.starts[a:b] - low, self.ends[a:b] - low
            out[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            a = b
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of `width` words within one text, and the word at which each begins."""
        room = np.maximum(self.counts() - width + 1, 0)
        at = np.repeat(self.offsets[:-1] - np.concatenate(([0], np.cumsum(room)[:-1])), room) + np.arange(room.sum())
        return rolling(self.hashes, width)[at], at

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()
