"""Spelling variants against a plain comparison of all words."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from surco.llm import queries, spelling

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain_counts(rows, least_letters=5, least_count=3, slip=None):
    counts = collections.Counter()
    for key, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{key}:{word}".encode())
            if slip and key is not None and h % slip == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= least_letters:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def plain_rows(counts, times=2):
    """By the texts that remain when a letter is deleted or covered."""
    holes = collections.defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            holes["-", w[:i] + w[i + 1:]].add(w)
            holes[i, w[:i] + "?" + w[i + 1:]].add(w)
    near = collections.defaultdict(set)
    for (kind, text), words in holes.items():
        for w in words:
            near[w] |= words - {w} if kind != "-" else set()
        if kind == "-" and text in counts:
            near[text] |= words
            for w in words:
                near[w].add(text)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def told(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def variants_of(rng, alphabet, many):
    """Words and edits of them, edits of edits too, anagrams, all with some count."""
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 9))) for _ in range(many)]
    for _ in range(3 * many):
        w = rng.choice(words)
        i = rng.randrange(len(w))
        words.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1:], "".join(sorted(w))]))
    return words


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "aé×ÿz"])
def test_against_all_words(spark, monkeypatch, alphabet):
    rng = random.Random(len(alphabet))
    words = [w for w in variants_of(rng, alphabet, 60) if w]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ".", "1", "Ā"]) for _ in range(90))) for i in range(30)]
    rows += [(None, " ".join(words[:50])), (3, None), (4, ""), (5, "A" * 70 + " " + "a" * 71), (5, "A" * 70 + " " + "a" * 71), (5, "A" * 70 + " " + "a" * 71)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, word string, n long")
    for slip in (None, 7):
        counts = plain_counts(rows, slip=slip)
        assert told(spelling.variants(df, slip=slip)) == plain_rows(counts)
    monkeypatch.setattr(spelling, "TILE", 12)  # many leaves, and leaves of several tiles
    monkeypatch.setattr(spelling, "SAMPLE", 40)
    assert told(spelling.variants(df, slip=7)) == plain_rows(counts)


def test_trees_reach_all_that_is_near():
    rng = random.Random(5)
    words = sorted({w.encode("latin-1") for w in variants_of(rng, "abcd", 150) if len(w) == 6})
    longer = sorted({w.encode("latin-1") for w in variants_of(rng, "abcd", 300) if len(w) == 7})
    for held, good in ((words, spelling.one_replaced), (longer, spelling.one_inserted)):
        got = {(int(i), int(j)) for a, b in spelling.near_pairs(words, held) for i, j in zip(a, b)}
        one = [np.frombuffer(w, np.uint8)[None] for w in words]
        other = [np.frombuffer(w, np.uint8)[None] for w in held]
        assert got == {(i, j) for i in range(len(one)) for j in range(len(other)) if good(one[i], other[j])[0]} and got
        tree = spelling.Tree(spelling.vectors(held), 4)
        assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(len(held)))
        assert all(leaf == tree.place(spelling.vectors(held))[r] for leaf, rows in enumerate(tree.leaves) for r in rows)


def test_letter_order():
    def inserted(a, b):
        return bool(spelling.one_inserted(np.frombuffer(a, np.uint8)[None], np.frombuffer(b, np.uint8)[None])[0])

    assert inserted(b"abcde", b"abcdex") and inserted(b"abcde", b"xabcde") and inserted(b"aabbc", b"aaabbc")
    assert not inserted(b"abcde", b"abdcex") and not inserted(b"abcde", b"edcbax")


def test_checksums():
    data = np.frombuffer(b"one twothree" + b"x" * 200, np.uint8)
    starts, ends = np.array([0, 4, 7, 12, 4]), np.array([3, 7, 12, 212, 4])
    before = np.array([0, zlib.crc32(b"9:"), 5, zlib.crc32(b"-1:"), 77], np.uint32)
    got = spelling.checksums(data, starts, ends, before).tolist()
    assert got == [zlib.crc32(data[s:e].tobytes(), int(b)) for s, e, b in zip(starts, ends, before)]


def test_long_chains_end_at_the_root(spark):
    rows = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w37"), ("b", "w0")]
    got = spelling.roots(spark.createDataFrame(rows, "word string, form string"))
    assert {tuple(r) for r in got.collect()} == {(w, "w37") for w, _ in rows}


def test_query_on_the_table(spark, smallest):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{smallest}/documents.parquet").select("doc_id", "text").collect()]
    assert told(queries.op12_spelling(spark, smallest)) == plain_rows(plain_counts(docs, slip=97))


def test_nothing(spark, nothing):
    assert told(spelling.variants(nothing)) == []
