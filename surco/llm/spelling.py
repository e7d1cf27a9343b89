"""Spelling variants: words one letter apart, and the commonest form of each.

Words are vectors of letter counts. One inserted or deleted letter changes one
count by one; one replaced letter lowers one count and raises another. Such
vectors are found by k-d trees, one per length: a search follows every branch
that a box of one up, and for equal lengths one down, can reach. Only then are
the letters compared in their order.

Upper trees, built from a bounded sample of words, deal the words to tiles; a
word asks in every tile that its box reaches, and the tile's task builds the tree
of its own words. Tiles count and rank what they find, so no pair is ever a row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import kept, written
from .words import slices

# Words of one tile and of one leaf; words in the sample of the upper trees, none of more letters than LONGEST.
TILE, LEAF, SAMPLE, LONGEST = 20_000, 48, 16_384, 64
SLICE_BYTES, PAIRS = 8 << 20, 1 << 20
LATIN = "ISO-8859-1"
# Fixed value: the polynomial of CRC-32, bits in reverse.
_POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] of each word, going on from the checksum `before` it."""
    out = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(starts - ends, kind="stable")  # long ones first: those still open are a prefix
    at, sizes, state = starts[order], (ends - starts)[order], out[order]
    for j in range(int(min(sizes.max(initial=0), LONGEST))):
        n = int(np.searchsorted(-sizes, -j, side="left"))
        part = state[:n]
        state[:n] = _CRC[(part ^ data[at[:n] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    for i in range(int(np.searchsorted(-sizes, -LONGEST, side="left"))):
        state[i] = zlib.crc32(data[at[i] + LONGEST:at[i] + sizes[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out[order] = state
    return out ^ np.uint32(0xFFFFFFFF)


def tally(keys: list[object], texts: list[str | None], least: int, slip: int | None) -> tuple[pa.Array, pa.Array]:
    """Distinct words of `least` letters or more, in Latin-1, and how often each occurs.

    With `slip`, a word loses a letter where that number divides the checksum of
    `key:word`: the letter at the checksum modulo its length. Null keys lose none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8).copy()
    data[(data >= 65) & (data <= 90)] += 32
    lead = data == 0xC3
    plain = (data >= 97) & (data <= 122)
    second = np.concatenate(([False], lead[:-1]))
    inside = np.concatenate(([False], plain | lead | second, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    letters = np.concatenate(([0], np.cumsum(plain | second)))  # one per letter, at its last byte
    sizes = letters[ends] - letters[starts]
    enough = sizes >= least
    starts, ends, sizes = starts[enough], ends[enough], sizes[enough]
    slipped: list[bytes] = []
    if slip and len(starts):
        offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
        of = np.searchsorted(offsets, starts, side="right") - 1
        before = np.array([0 if k is None else zlib.crc32(f"{k}:".encode()) for k in keys], np.uint32)
        sums = checksums(data, starts, ends, before[of])
        known = np.array([k is not None for k in keys])
        hit = (sums % np.uint32(slip) == 0) & known[of]
        for i in np.flatnonzero(hit).tolist():
            word = data[starts[i]:ends[i]].tobytes().decode().encode("latin-1")
            at = int(sums[i]) % len(word)
            if len(word) > least:
                slipped.append(word[:at] + word[at + 1:])
        starts, ends, sizes = starts[~hit], ends[~hit], sizes[~hit]
    latin = np.where(second, data + np.uint8(0x40), data)
    mark = np.zeros(len(data) + 1, np.int8)
    np.add.at(mark, starts, 1)
    np.add.at(mark, ends, -1)
    taken = latin[(np.cumsum(mark[:-1], dtype=np.int8) > 0) & (plain | second)]
    places = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(taken))])
    counted = pa.concat_arrays([words, pa.array(slipped, pa.binary())]).value_counts()
    return counted.field(0), counted.field(1)


def count_words(df: DataFrame, key: str, text: str, least_letters: int, least_count: int, slip: int | None) -> DataFrame:
    """`word` in Latin-1, `n`: the words of all texts that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                words, n = tally(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), least_letters, slip)
                yield pa.RecordBatch.from_arrays([words, n.cast(pa.int64())], names=["word", "n"])

    parts = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def vectors(words: list[bytes]) -> np.ndarray:
    """Counts of each of the 256 letters, a row per word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    rows = np.repeat(np.arange(len(words)), sizes)
    return np.bincount(rows * 256 + codes, minlength=len(words) * 256).reshape(-1, 256)


class Tree:
    """A k-d tree over rows of counts: nodes split at a count of the letter that varies most; equal rows stay together."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.nodes: list[tuple[int, int, int, int]] = []  # letter, count, left, right; a leaf is (-1, its number, 0, 0)
        self.leaves: list[np.ndarray] = []
        if len(x):
            self._grow(x, np.arange(len(x)), leaf)

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int) -> None:
        todo = [(rows, -1, False)]
        while todo:
            rows, parent, right = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                k, c, a, b = self.nodes[parent]
                self.nodes[parent] = (k, c, a, me) if right else (k, c, me, b)
            here = x[rows]
            letter = int(here.var(axis=0).argmax()) if len(rows) > leaf else -1
            if letter < 0 or here[:, letter].min() == here[:, letter].max():
                self.nodes.append((-1, len(self.leaves), 0, 0))
                self.leaves.append(rows)
                continue
            values = here[:, letter]
            count = min(int(np.median(values)), int(values.max()) - 1)
            low = values <= count
            self.nodes.append((letter, count, -1, -1))
            todo.append((rows[~low], me, True))
            todo.append((rows[low], me, False))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            node, rows = todo.pop()
            letter, count, left, right = self.nodes[node]
            if letter < 0:
                out[rows] = count
                continue
            low = x[rows, letter] <= count
            todo += [(left, rows[low]), (right, rows[~low])]
        return out

    def reach(self, x: np.ndarray, down: bool) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves and the rows whose box reaches them: one letter more, and with `down` one other letter less."""
        if not self.nodes or not len(x):
            return
        n = len(x)
        none = np.full(n, -1, np.int16)
        todo = [(0, np.arange(n), none, none if down else np.full(n, -2, np.int16))]
        while todo:
            node, rows, up, less = todo.pop()  # the letter that was raised or lowered on the way, -1 none yet, -2 not allowed
            letter, count, left, right = self.nodes[node]
            if letter < 0:
                yield count, rows
                continue
            values = x[rows, letter] + (up == letter) - (less == letter)
            low = values <= count
            fall = (values == count + 1) & (less == -1) & (up != letter)
            rise = (values == count) & (up == -1) & (less != letter)
            for child, stay, step in ((left, low, fall), (right, ~low, rise)):
                both = np.concatenate((np.flatnonzero(stay), np.flatnonzero(step)))
                if not len(both):
                    continue
                u, v = up[both], less[both]
                (v if child == left else u)[int(stay.sum()):] = letter
                todo.append((child, rows[both], u, v))


def _letters(words: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether the long word is the short one with a letter put in: a common start and a common end cover the short one."""
    size = short.shape[1]
    before, after = short != long[:, :-1], short != long[:, 1:]
    start = np.where(before.any(axis=1), before.argmax(axis=1), size)
    end = np.where(after.any(axis=1), size - after[:, ::-1].argmax(axis=1), 0)
    return end <= start


def near_pairs(asking: list[bytes], held: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of asking and held words one letter apart; each list has words of one length, the held ones as long or one longer."""
    if not asking or not held:
        return
    size = len(asking[0])
    down = len(held[0]) == size
    x, y = vectors(asking), vectors(held)
    used = np.flatnonzero(y.any(axis=0) | x.any(axis=0))
    x, y = x[:, used], y[:, used]
    a, b = _letters(asking, size), _letters(held, len(held[0]))
    fx, fy = x.astype(np.float64), y.astype(np.float64)
    xx, yy = (fx * fx).sum(axis=1), (fy * fy).sum(axis=1)
    tree = Tree(y, LEAF)
    check, far = (one_replaced, 2) if down else (one_inserted, 1)
    for leaf, rows in tree.reach(x, down):
        points = tree.leaves[leaf]
        step = max(1, PAIRS // len(points))
        for at in range(0, len(rows), step):
            part = rows[at:at + step]
            i, j = np.nonzero(xx[part][:, None] + yy[points] - 2 * (fx[part] @ fy[points].T) == far)
            i, j = part[i], points[j]
            good = check(a[i], b[j])
            if good.any():
                yield i[good], j[good]


def _sample_trees(words: DataFrame, total: int) -> dict[int, tuple[Tree, np.ndarray, np.ndarray]]:
    """Per length the upper tree, each leaf's first tile and its number of tiles."""
    rows = words.filter(F.length("word") <= LONGEST).orderBy(F.xxhash64("word"), "word").limit(SAMPLE).select("word").collect()
    by_size: dict[int, list[bytes]] = {}
    for r in rows:
        by_size.setdefault(len(r["word"]), []).append(bytes(r["word"]))
    each = total / max(1, len(rows))  # words that one of the sample stands for
    out = {}
    for size, sample in by_size.items():
        tree = Tree(vectors(sample), max(8, int(TILE / each)))
        tiles = np.maximum(1, np.rint(np.array([len(p) for p in tree.leaves]) * each / TILE)).astype(np.int64)
        out[size] = tree, np.concatenate(([0], np.cumsum(tiles)[:-1])), tiles
    return out


def _dealt(words: DataFrame, trees: dict[int, tuple[Tree, np.ndarray, np.ndarray]], ask: bool) -> DataFrame:
    """`size, tile, word, n`: each word at its own tile, or at all that it has to ask; a leaf of several tiles is dealt by checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_, n = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.fromiter(map(len, words_), np.int64, len(words_))
            found: list[tuple[np.ndarray, int, np.ndarray]] = []  # rows, length of the held words, tile
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                mine = [words_[i] for i in rows]
                for target in (size, size + 1) if ask else (size,):
                    if target not in trees:
                        found.append((rows, target, np.zeros(len(rows), np.int64)))
                        continue
                    tree, first, tiles = trees[target]
                    x = vectors(mine)
                    if not ask:
                        leaf = tree.place(x)
                        found.append((rows, target, first[leaf] + np.array([zlib.crc32(w) for w in mine], np.int64) % tiles[leaf]))
                        continue
                    for leaf, some in tree.reach(x, target == size):
                        found += [(rows[some], target, np.full(len(some), first[leaf] + t)) for t in range(int(tiles[leaf]))]
            take = pa.array(np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64))
            target = np.concatenate([np.full(len(f[0]), f[1]) for f in found]) if found else np.empty(0, np.int64)
            tile = np.concatenate([f[2] for f in found]) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(target, pa.int64()), pa.array(tile, pa.int64()), batch.column(0).take(take), n.take(take)],
                                             names=["size", "tile", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "size long, tile long, word binary, n long")


def _found(asking: pa.Table, held: pa.Table) -> pa.Table:
    """What one tile knows of its words: `word, n_near, best_n, best`, one row per word with anything near.

    An asking word of the same length asks for itself; one that is a letter
    shorter also tells the held words about itself.
    """
    held_words, held_n = held.column("word").to_pylist(), held.column("n").to_numpy()
    ask_words, ask_n = asking.column("word").to_pylist(), asking.column("n").to_numpy()
    rows: dict[bytes, tuple[int, int, bytes]] = {}

    def best(owner: np.ndarray, other: np.ndarray, owners: list[bytes], others: list[bytes], n: np.ndarray) -> None:
        for o, p in zip(owner.tolist(), other.tolist(), strict=True):
            count, top, word = rows.get(owners[o], (0, 0, b""))
            better = n[p] > top or (n[p] == top and others[p] < word)
            rows[owners[o]] = (count + 1, int(n[p]), others[p]) if better else (count + 1, top, word)

    if held_words:
        size = len(held_words[0])
        lengths = np.fromiter(map(len, ask_words), np.int64, len(ask_words))
        for mine in (size, size - 1):
            which = np.flatnonzero(lengths == mine)
            for i, j in near_pairs([ask_words[k] for k in which], held_words):
                best(which[i], j, ask_words, held_words, held_n)
                if mine < size:
                    best(j, which[i], held_words, ask_words, ask_n)
    return pa.table({
        "word": pa.array(list(rows), pa.binary()), "n_near": pa.array([r[0] for r in rows.values()], pa.int64()),
        "best_n": pa.array([r[1] for r in rows.values()], pa.int64()), "best": pa.array([r[2] for r in rows.values()], pa.binary()),
    })


def roots(forms: DataFrame) -> DataFrame:
    """`word, root` for rows `word, form`: forms followed to the last, in twice as long steps each time."""
    ends = kept(forms.select("word", F.col("form").alias("root")))
    while True:
        after = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = kept(ends.drop("moved").join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ends.filter("moved").isEmpty():
            return ends.select("word", "root")


def variants(
    df: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 5, least_count: int = 3, times: int = 2, slip: int | None = None,
) -> DataFrame:
    """One row per word of all texts: word, form, root, n, n_near, form_n.

    Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z made
    small, with `least_letters` letters and `least_count` occurrences or more. Two
    are near if one inserted, deleted or replaced letter makes them equal. The form
    of a word is its commonest near word (of equal ones the first in code point
    order) if it occurs `times` as often or more, else null; `form_n` is its count.
    `root` follows forms to the last one. Null and empty texts have no words; a
    repeated row counts again; `key` matters only for `slip` (see `tally`), and a
    null key never slips. Other columns are not read. An empty table gives no rows.
    """
    if times < 2:
        raise ValueError("forms could go in circles: times must be 2 or more")
    words = written(count_words(df, key, text, least_letters, least_count, slip))
    trees = _sample_trees(words, words.count())
    asking, held = _dealt(words, trees, True), _dealt(words, trees, False)
    schema = "word binary, n_near long, best_n long, best binary"
    found = asking.groupBy("size", "tile").cogroup(held.groupBy("size", "tile")).applyInArrow(_found, schema)
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    joined = words.join(near, "word", "left")
    common = -F.col("first.less") >= times * F.col("n")
    rows = written(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("first.best")).alias("form"), F.when(common, -F.col("first.less")).alias("form_n")))
    ends = roots(rows.filter(F.col("form").isNotNull()))
    out = rows.join(ends, "word", "left")
    told = [F.decode(c, LATIN).alias(n) for c, n in ((F.col("word"), "word"), (F.col("form"), "form"), (F.coalesce("root", "word"), "root"))]
    return out.select(*told, "n", "n_near", "form_n")
