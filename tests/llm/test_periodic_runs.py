"""Runs against a plain search of every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from surco.llm import periodic_runs, queries


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            if words[start] != words[start + q]:
                start += 1
                continue
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            if length >= max(6, 4 * q) and not any(all(words[j] == words[j + p] for j in range(start, start + length - p)) for p in range(1, q)):
                out.append((start, length, q))
            start = end
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(key, text):
    words = (text or "").encode().split()
    n, h = len(words), 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode(), b" ".join(w for i, w in enumerate(words) if i not in gone))]
    return (key, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, *sha)


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_small_alphabets(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = []
        for _ in range(rng.randrange(1, 8)):
            k = rng.choice([1, 2, 2, 3, 5])
            words = [rng.randrange(k) for _ in range(rng.randrange(120))]
            for _ in range(rng.randrange(3)):
                p, at = rng.randrange(1, 12), rng.randrange(len(words) + 1)
                words[at:at] = ([rng.randrange(k) for _ in range(p)] * 12)[:rng.randrange(p, 9 * p + 1)]
            texts.append(words)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        values = np.array([v for t in texts for v in t] or [0], np.uint64)[:offsets[-1]]
        assert periodic_runs.find_runs(values, offsets) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("width", [1, 2, 8, 64])
@pytest.mark.parametrize("largest", [3, 1 << 15, 1 << 30])
def test_sums_of_squares_are_exact(width, largest):
    """One, two or three primes, as the largest sum needs: zero differences and no other."""
    rng = np.random.default_rng(width)
    x = rng.integers(0, largest, 40 * width).astype(np.uint64)
    x[7 * width:8 * width] = x[5 * width:6 * width]
    x[13 * width + 1:14 * width + 1] = x[12 * width:13 * width]
    starts = np.arange(0, 36 * width, width)
    got = set(zip(*(a.tolist() for a in periodic_runs.occurrences(x, starts, width)), strict=True))
    assert got == {(s, d) for s in starts.tolist() for d in range(width, 2 * width) if (x[s:s + width] == x[s + d:s + d + width]).all()}
    p, root = periodic_runs.PRIMES[0]
    sums = periodic_runs.mismatches(x[None, :width], x[None, width:3 * width], p, root)[0].tolist()
    assert sums == [sum((int(a) - int(b)) ** 2 for a, b in zip(x[:width], x[width + i:2 * width + i], strict=True)) % p for i in range(width)]


def test_long_runs_stay_cheap():
    """A text of one word, one of two words with breaks: found without a seed per pair of places."""
    assert periodic_runs.find_runs(np.zeros(200_000, np.uint64), np.array([0, 200_000])) == [[(0, 200_000, 1)]]
    x = (np.arange(60_000) % 2).astype(np.uint64)
    x[::997] = 5
    got = periodic_runs.find_runs(x, np.array([0, 60_000]))[0]
    assert (0, 60_000, 1994) in got and len(got) == 1 + -(-60_000 // 997)


def test_query_against_plain_rows(spark, corpus, texts, tmp_path):
    rows = corpus.unionByName(spark.createDataFrame(
        [(9000 + i, t, *[None] * 8) for i, t in enumerate(["a b " * 9, "x " * 6, "x " * 5, "q " + "a b c d " * 4, "    " * 8, "A a " * 4])], corpus.schema))
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    # The long text has no run by itself; its rotation of words is found by the plain search too, but slowly.
    whole = [(r["doc_id"], r["text"]) for r in rows.collect()]
    short = [(k, t) for k, t in whole if len((t or "").split()) < 2000]
    assert len(got) == len(whole)
    known = sorted((plain_row(k, t) for k, t in short), key=str)
    ids = {k for k, _ in short}
    assert [r for r in got if r[0] in ids] == known
    assert any(r[1] for r in known) and any(r[1] == 0 for r in known)


def test_parts_of_any_size(spark, corpus):
    """The slices that texts are handled in do not change a row."""
    columns = ["doc_id", "n_words", "runs", "best", "collapsed"]
    whole = sorted(map(str, periodic_runs.runs(corpus, tail=queries.repeated_tail).select(*columns).collect()))
    rows = corpus.select(corpus["key"].alias("doc_id"), corpus["text"].alias("body"), corpus["doc_id"].alias("key"))
    other = periodic_runs.runs(rows, key="key", text="body", tail=queries.repeated_tail, slice_bytes=1)
    assert other.columns == ["key", *columns[1:]]
    assert sorted(str(r).replace("Row(key=", "Row(doc_id=", 1) for r in other.collect()) == whole


def test_nothing(spark, nothing):
    assert periodic_runs.runs(nothing).count() == 0
