"""Byte-level BPE encoding and decoding with a given table of ranks.

Each piece that the pattern cuts is merged on its own. A segment tree over its
byte positions holds, at every node, the leftmost pair of the lowest rank below;
a merge reads the root and updates the leaves of the two pairs that changed,
each in a logarithmic number of steps. Pieces of about the same length go
through their trees together, one merge each per step.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .words import in_parts

NONE = np.int64(1) << 62
# Pieces whose ids a worker remembers; beyond it only those met since then stay.
REMEMBERED = 250_000
# Rows of ids decoded at once.
IDS_AT_ONCE = 512
# Trees that are merged together: positions in all of them.
TOGETHER = 1 << 18


def read_ranks(path: str) -> Iterator[tuple[bytes, int]]:
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                yield base64.b64decode(token), int(rank)


@lru_cache(maxsize=2)
def tokens_of(path: str) -> list[bytes]:
    """The bytes of every id: all that decoding needs."""
    ranks = dict(read_ranks(path))
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class Ranks:
    """The ranks of a vocabulary, and of every pair of tokens that joins to a token."""

    def __init__(self, path: str):
        ranks = dict(read_ranks(path))
        self.tokens = tokens_of(path)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (a << 32 | b, rank)
            for token, rank in ranks.items() for i in range(1, len(token))
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None
        ]
        pairs.sort()
        keys = np.array([p[0] for p in pairs], np.uint64)
        self._bits = np.uint64(64 - max(4, (4 * len(pairs)).bit_length()))
        self._keys = np.full((1 << int(64 - self._bits)) + 64, 1 << 63, np.uint64)
        self._values = np.full(len(self._keys), NONE, np.int64)
        at = self._place(keys)
        todo = np.arange(len(keys))
        while len(todo):  # each key goes to the first free slot from its own on
            free = self._keys[at[todo]] == 1 << 63
            self._keys[at[todo[free]]] = keys[todo[free]]
            placed = self._keys[at[todo]] == keys[todo]
            todo = todo[~placed]
            at[todo] += 1
        self._values[at] = [p[1] for p in pairs]
        self._steps = int((at - self._place(keys)).max(initial=0)) + 1
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._bits).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, or NONE."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._place(keys)
        out = self._values[at]
        wrong = np.flatnonzero(self._keys[at] != keys)
        out[wrong] = NONE
        for _ in range(1, self._steps):
            if not len(wrong):
                break
            at[wrong] += 1
            found = self._keys[at[wrong]]
            hit = found == keys[wrong]
            out[wrong[hit]] = self._values[at[wrong[hit]]]
            wrong = wrong[~hit & (found != 1 << 63)]
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids, as little-endian 32-bit integers, of pieces of 2 to 2^k bytes, all with a tree of the same size."""
        n, wide = len(pieces), max(map(len, pieces))
        leaves = 1 << (wide - 1).bit_length()
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, leaves + 1), -1, np.int64)
        inside = np.arange(leaves + 1) < sizes[:, None]
        ids[inside] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, leaves + 2), (n, leaves + 1)).copy()  # the live position that follows
        before = after - 2
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        pair = inside[:, 1:]
        rank = np.full((n, leaves), NONE, np.int64)
        rank[pair] = self.join(ids[:, :-1][pair], ids[:, 1:][pair])
        # A node is rank times positions plus position: the least is the leftmost of the lowest rank.
        spots = np.arange(leaves)
        tree[:, leaves:] = np.where(rank < NONE, rank * leaves + spots, NONE)
        level = leaves
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        row_i, row_t = np.arange(n) * (leaves + 1), np.arange(n) * 2 * leaves
        live = np.flatnonzero(tree[row_t + 1] < NONE)
        while len(live):
            ri, rt, end = row_i[live], row_t[live], sizes[live]
            root = tree[rt + 1]
            merged, p = root // leaves, root % leaves
            q = after[ri + p]
            r = after[ri + q]
            ids[ri + p] = merged
            ids[ri + q] = -1
            after[ri + p] = r
            before[ri + np.minimum(r, leaves)] = p
            o = before[ri + p]
            self._set(tree, rt, leaves, q, np.full(len(live), NONE))
            new = np.full(len(live), NONE)
            has = np.flatnonzero(r < end)
            new[has] = self.join(merged[has], ids[ri[has] + r[has]])
            self._set(tree, rt, leaves, p, np.where(new < NONE, new * leaves + p, NONE))
            has = np.flatnonzero(o >= 0)
            if len(has):
                new = self.join(ids[ri[has] + o[has]], merged[has])
                self._set(tree, rt[has], leaves, o[has], np.where(new < NONE, new * leaves + o[has], NONE))
            live = live[tree[rt + 1] < NONE]
        kept = ids >= 0
        flat = ids[kept].astype("<u4").tobytes()
        cuts = (4 * np.concatenate(([0], np.cumsum(kept.reshape(n, leaves + 1).sum(axis=1))))).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    @staticmethod
    def _set(tree: np.ndarray, row: np.ndarray, leaves: int, at: np.ndarray, value: np.ndarray) -> None:
        """Put one value into a leaf of each tree and renew the nodes above it."""
        node = at + leaves
        tree[row + node] = value
        while leaves > 1:
            node >>= 1
            low = row + 2 * node
            tree[row + node] = np.minimum(tree[low], tree[low + 1])
            leaves >>= 1

    def merge_long(self, piece: bytes) -> bytes:
        """One long piece with a tree of its own."""
        n = len(piece)
        leaves = 1 << (n - 1).bit_length()
        none = int(NONE)
        ids = self.bytes[np.frombuffer(piece, np.uint8)]
        rank = self.join(ids[:-1], ids[1:])
        low = np.full(2 * leaves, NONE, np.int64)
        low[leaves:leaves + n - 1] = np.where(rank < NONE, rank * leaves + np.arange(n - 1), NONE)
        level = leaves
        while level > 1:
            low[level // 2:level] = np.minimum(low[level:2 * level:2], low[level + 1:2 * level:2])
            level //= 2
        tree, ids = low.tolist(), ids.tolist()
        after, before = list(range(1, n + 2)), list(range(-1, n))

        def put(at: int, value: int) -> None:
            node = at + leaves
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                best = a if a < b else b
                if tree[node] == best:
                    break
                tree[node] = best

        def key(at: int, right: int) -> int:
            joined = self.pair(ids[at], ids[right])
            return none if joined is None else joined * leaves + at

        while tree[1] < none:
            merged, p = divmod(tree[1], leaves)
            q = after[p]
            r = after[q]
            ids[p], ids[q], after[p] = merged, -1, r
            if r < n:
                before[r] = p
            put(q, none)
            put(p, key(p, r) if r < n else none)
            if before[p] >= 0:
                put(before[p], key(before[p], p))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def pair(self, left: int, right: int) -> int | None:
        key = left << 32 | right
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self._bits)
        for i in range(at, at + self._steps):
            if self._keys[i] == key:
                return int(self._values[i])
        return None

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces that are not known yet."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if len(raw) == 1:
                self.memory[piece] = self.bytes[raw[0]].astype("<u4").tobytes()
            else:
                by_size.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for size, group in by_size.items():
            if size > 7 and len(group) < 1 << (size - 4):
                for piece, raw in group:
                    self.memory[piece] = self.merge_long(raw)
                continue
            step = max(1, TOGETHER >> size)
            for i in range(0, len(group), step):
                part = group[i:i + step]
                self.memory.update(zip([piece for piece, _ in part], self.merge([raw for _, raw in part]), strict=True))

    def encode(self, texts: list[str | None], pattern: regex.Pattern) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        for i in range(0, len(texts), 128):
            cut = [pattern.findall(t) if t else [] for t in texts[i:i + 128]]
            if len(self.memory) > REMEMBERED:
                self.memory, self.older = {}, self.memory
            known, older = self.memory, self.older
            new = set().union(*cut).difference(known)
            seen = {p for p in new if p in older}
            known.update((p, older[p]) for p in seen)
            self.learn(list(new - seen))
            for pieces in cut:
                yield b"".join(map(known.__getitem__, pieces))

    def forget(self) -> None:
        """Give up the pieces of a task that has ended: its Python worker lives on and serves other stages."""
        self.memory, self.older = {}, {}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(maxsize=2)
def pattern_of(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """All columns of `df` and an array column with the ids of the text.

    A null or empty text gives an empty array. A column named `out` that is
    already there is replaced. Repeated rows stay as many as they are.
    """
    kept = [c for c in df.columns if c != out]
    schema = df.select(*[df[quoted(c)] for c in kept]).schema.add(out, ArrayType(IntegerType()))

    def run(batches):
        ranks, cut = ranks_of(path), pattern_of(pattern)
        for batch in in_parts(batches, kept.index(text)):
            ids = [np.frombuffer(b, "<i4") for b in ranks.encode(batch.column(kept.index(text)).to_pylist(), cut)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*kept, out])
        ranks.forget()

    return df.select(*[df[quoted(c)] for c in kept]).mapInArrow(run, schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """All columns of `df` and a binary column with the bytes of the ids; null ids give null."""
    kept = [c for c in df.columns if c != out]
    schema = df.select(*[df[quoted(c)] for c in kept]).schema.add(out, "binary")

    def run(batches):
        tokens = tokens_of(path)
        for batch in (b.slice(i, IDS_AT_ONCE) for b in batches for i in range(0, len(b), IDS_AT_ONCE)):
            rows = [None if x is None else b"".join(map(tokens.__getitem__, x)) for x in batch.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], names=[*kept, out])

    return df.select(*[df[quoted(c)] for c in kept]).mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, number of ids, and SHA-256 of the ids and of the bytes that they decode to."""
    schema = df.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        ranks, cut = ranks_of(path), pattern_of(pattern)
        for batch in in_parts(batches, 1):
            ids = list(ranks.encode(batch.column(1).to_pylist(), cut))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(ranks.decode(x)).hexdigest() for x in ids]),
            ], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
        ranks.forget()

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)
