"""Runs: stretches of words that repeat themselves with some period.

The words of many texts stand in one array of numbers. At each scale B = 1, 2,
4, ... it is cut into blocks of B words, and for each block the sum of squared
differences to every place B to 2B - 1 words later is computed at once, exactly,
by number-theoretic transforms. Where it is zero the block occurs again; the
distance and the block are a seed, which is extended both ways while words at
that distance are alike. A run of at least four periods of q words, B <= q < 2B,
holds a whole block with its next occurrence at q, so no run is missed.

Blocks are not transformed if their first words (up to four) do not occur again
in the window, or if they lie inside a run already found: every distance there
is a multiple of its period.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .words import mix, slices

# Primes with 2^26 dividing p - 1, and a generator of each.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
LEAST_WORDS, LEAST_PERIODS = 6, 4
# Bytes of text handled at once, unless one text is longer, and numbers in one batch of transforms.
SLICE_BYTES, BATCH = 2 << 20, 1 << 19

Tail = Callable[[object, int], tuple[int, int] | None]


@lru_cache(maxsize=256)
def _twiddles(p: int, root: int, n: int, back: bool) -> np.ndarray:
    """The first n / 2 powers of an n-th root of one."""
    w = pow(root, (p - 1) // n, p)
    if back:
        w = pow(w, -1, p)
    out = np.ones(1, np.uint64)
    while len(out) < n // 2:
        out = np.concatenate((out, out * np.uint64(pow(w, len(out), p)) % np.uint64(p)))
    return out


def _transform(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """Rows to their spectra, in the order that `_back` takes."""
    q, n = np.uint64(p), x.shape[1]
    half = n // 2
    while half:
        pairs = x.reshape(len(x), -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        out = np.empty_like(pairs)
        out[:, :, 0] = (a + b) % q
        out[:, :, 1] = (a + q - b) * _twiddles(p, root, 2 * half, False) % q
        x = out.reshape(len(x), n)
        half //= 2
    return x


def _back(x: np.ndarray, p: int, root: int) -> np.ndarray:
    q, n = np.uint64(p), x.shape[1]
    half = 1
    while half < n:
        pairs = x.reshape(len(x), -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1] * _twiddles(p, root, 2 * half, True) % q
        out = np.empty_like(pairs)
        out[:, :, 0] = (a + b) % q
        out[:, :, 1] = (a + q - b) % q
        x = out.reshape(len(x), n)
        half *= 2
    return x * np.uint64(pow(n, -1, p)) % q


def mismatches(blocks: np.ndarray, windows: np.ndarray, p: int, root: int) -> np.ndarray:
    """Modulo p, the sum of squared differences of each block (B numbers) to each of the B places of its window (2B numbers)."""
    q, width = np.uint64(p), blocks.shape[1]
    blocks, windows = blocks % q, windows % q
    padded = np.zeros_like(windows)
    padded[:, 0] = blocks[:, 0]
    padded[:, width + 1:] = blocks[:, :0:-1]  # reversed in time, so that the product of spectra is a correlation
    both = _back(_transform(padded, p, root) * _transform(windows, p, root) % q, p, root)[:, :width]
    sums = np.zeros((len(windows), 2 * width + 1), np.uint64)
    np.cumsum(windows * windows % q, axis=1, out=sums[:, 1:])
    squares = (sums[:, width:2 * width] - sums[:, :width]) % q + (blocks * blocks % q).sum(axis=1, dtype=np.uint64)[:, None] % q
    return (squares + q + q - both - both) % q


def occurrences(x: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and distances, width <= distance < 2 width, at which the block of `width` numbers occurs again; `x` reaches 3 width beyond a start.

    As many primes are used as the largest sum needs, so zero means zero.
    """
    largest = width * int(x.max(initial=1)) ** 2
    used, product = 0, 1
    while product <= largest:
        product *= PRIMES[used][0]
        used += 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, BATCH // (2 * width))
    for a in range(0, len(starts), step):
        at = starts[a:a + step]
        zero = None
        for p, root in PRIMES[:used]:
            if not len(at):
                break
            spans = x[at[:, None] + np.arange(3 * width)]
            zeros = mismatches(spans[:, :width], spans[:, width:], p, root) == 0
            zero = zeros if zero is None else zero & zeros
            some = zero.any(axis=1)
            at, zero = at[some], zero[some]
        if len(at):
            row, offset = np.nonzero(zero)
            found.append((at[row], offset + width))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many first values of a and b are the same."""
    done, step, n = 0, 64, len(a)
    while done < n:
        differ = a[done:done + step] != b[done:done + step]
        if differ.any():
            return done + int(differ.argmax())
        done += step
        step *= 2
    return n


def stretch(x: np.ndarray, start: int, period: int, low: int, high: int) -> tuple[int, int]:
    """The longest stretch around `start`, within low and high, in which words `period` apart are alike."""
    right = start + _alike(x[start:high - period], x[start + period:high])
    left = start - _alike(x[low:start][::-1], x[low + period:start + period][::-1])
    return left, right + period


@lru_cache(maxsize=4096)
def _prime_factors(n: int) -> tuple[int, ...]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return tuple(out + [n] * (n > 1))


def _recurring(codes: np.ndarray, ordered: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Those starts whose code comes again width to 2 width - 1 places later; `ordered` are code and place as one number, sorted."""
    wanted = (codes[starts] << np.uint64(32)) + (starts + width).astype(np.uint64)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return starts[(ordered[at] >= wanted) & (ordered[at] < wanted + np.uint64(width))]


def find_runs(values: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text, values[offsets[i]:offsets[i + 1]], its runs as (start, length, period) in order.

    A run has its smallest period q, at least LEAST_PERIODS times q and LEAST_WORDS
    words, and cannot be extended.
    """
    texts = len(offsets) - 1
    sizes = np.diff(offsets)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(texts)]
    longest = int(sizes.max(initial=0))
    if longest < LEAST_WORDS:
        return out
    # One number that no word has stands behind every text, and enough of it at the end.
    outside = int(values.max()) + 1
    x = np.full(len(values) + texts + 3 * longest, outside, np.uint64)
    firsts = offsets[:-1] + np.arange(texts)
    of = np.repeat(np.arange(texts), sizes)
    x[np.arange(len(values)) + of] = values
    room = np.zeros(len(values) + texts, np.int64)  # words from here to the end of the text
    room[np.arange(len(values)) + of] = np.repeat(offsets[1:], sizes) - np.arange(len(values))
    size_at = np.zeros(len(room), np.int64)
    size_at[np.arange(len(values)) + of] = np.repeat(sizes, sizes)
    reach = np.zeros(len(room), np.int64)  # to where a run found so far goes on
    place = np.arange(len(room), dtype=np.uint64)
    cut = np.uint64(33)
    codes = mix(x[:len(room)] + np.uint64(1)) >> cut
    ordered = None
    width = 1
    while LEAST_PERIODS * width <= longest:
        if width in (2, 4):
            later = np.concatenate((codes[width // 2:], np.zeros(width // 2, np.uint64)))
            codes, ordered = mix((codes << np.uint64(31)) + later) >> cut, None
        if ordered is None:
            ordered = np.sort((codes << np.uint64(32)) + place)
        starts = np.arange(0, len(room), width)
        starts = starts[(room[starts] >= 2 * width) & (size_at[starts] >= max(LEAST_WORDS, LEAST_PERIODS * width)) & (reach[starts] < starts + 3 * width - 1)]
        starts = _recurring(codes, ordered, starts, width)
        at, periods = occurrences(x, starts, width)
        open_ = (room[at] >= width + periods) & (reach[at] < at + width + periods)
        order = np.lexsort((at[open_], periods[open_]))
        last, end = 0, 0
        for start, period in zip(at[open_][order].tolist(), periods[open_][order].tolist(), strict=True):
            if (period == last and start + width + period <= end) or reach[start] >= start + width + period:
                continue
            i = int(np.searchsorted(firsts, start, side="right")) - 1
            low = int(firsts[i])
            left, end = stretch(x, start, period, low, low + int(sizes[i]))
            last = period
            if end - left < max(LEAST_WORDS, LEAST_PERIODS * period):
                continue
            once = x[left:left + period]
            if any(np.array_equal(once, x[left + period // f:left + period // f + period]) for f in _prime_factors(period)):
                continue
            out[i].append((left - low, end - left, period))
            reach[left:end] = np.maximum(reach[left:end], end)
        width *= 2
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def _best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods; of equal ones the first, then that of the smaller period."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def runs(df: DataFrame, key: str = "doc_id", text: str = "text", tail: Tail | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of `df`: key, n_words, runs, best and collapsed.

    `runs` are all runs of the text's words as (start, length, period), in order of
    start and period; `best` is the one with the greatest length / period (null
    without runs); `collapsed` is the text with each run cut to its first period,
    words joined by one space. Words are compared as they are. A null or empty text
    has no words, no runs and an empty collapsed text. Null keys, repeated rows and
    other columns do not matter; an empty table gives no rows.

    With `tail`, which gets the key and the number n of words, if any, and gives
    None or (a, p), the words from number a on are replaced by repetitions of the
    p words that begin there, before runs are looked for.
    """
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = to_arrow_type(rows.schema["key"].dataType)
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def part(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        for i, (k, w) in enumerate(zip(keys.to_pylist(), words, strict=True)):
            again = tail(k, len(w)) if tail and w else None
            if again:
                a, p = again
                words[i] = w[:a] + (w[a:a + p] * (-(-(len(w) - a) // p)))[:len(w) - a]
        offsets = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
        ids = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy()
        found = find_runs(ids.astype(np.uint64), offsets)
        collapsed, best = [], []
        for w, f in zip(words, found, strict=True):
            stay = np.ones(len(w), bool)
            for start, length, period in f:
                stay[start + period:start + length] = False
            collapsed.append(b" ".join([w[i] for i in np.flatnonzero(stay)] if f else w))
            best.append(_best(f))

        def told(r: tuple[int, int, int] | None) -> dict | None:
            return None if r is None else {"start": r[0], "length": r[1], "period": r[2]}

        return pa.RecordBatch.from_arrays([
            keys.cast(kind), pa.array([len(w) for w in words], pa.int64()), pa.array([[told(r) for r in f] for f in found], pa.list_(triple)),
            pa.array([told(r) for r in best], triple), pa.array([c.decode("utf-8", "surrogatepass") for c in collapsed], pa.string()),
        ], names=["key", "n_words", "runs", "best", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), slice_bytes):
                yield part(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).to_pylist())

    one = "struct<start: long, length: long, period: long>"
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_words long, runs array<{one}>, best {one}, collapsed string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
