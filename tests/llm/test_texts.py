"""Operators on texts against plain versions of the same rules."""

import base64
import collections
import hashlib
import heapq
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from surco.llm import byte_bpe, html_extract, mixing, odd_sketch, quality, sharding, substrings, suffix_tree
from surco.llm.words import Words, rolling

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words_of(text, lower=False):
    return ((text or "").translate(LOWER) if lower else text or "").encode().split()


def fold(key):
    return None if key is None else zlib.crc32(str(key).encode()) % 5


def test_words_and_windows(texts):
    words = Words([t for _, t in texts])
    got = [[words.text(i) for i in range(a, b)] for a, b in zip(words.offsets, words.offsets[1:])]
    assert got == [words_of(t) for _, t in texts]
    by_hash = collections.defaultdict(set)
    for i, h in enumerate(words.hashes.tolist()):
        by_hash[h].add(words.text(i))
    assert all(len(v) == 1 for v in by_hash.values()) and len(by_hash) == len({words.text(i) for i in range(len(words.hashes))})
    hashes, at = words.windows(5)
    seen = collections.defaultdict(set)
    for h, a in zip(hashes.tolist(), at.tolist()):
        seen[h].add(tuple(words.text(i) for i in range(a, a + 5)))
    assert all(len(v) == 1 for v in seen.values())
    assert len(hashes) == sum(max(0, len(words_of(t)) - 4) for _, t in texts)
    assert len(rolling(words.hashes[:3], 4)) == 0


# ---- HTML -------------------------------------------------------------------

PAGES = [
    ("<html><head><title>no</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; one</h1>"
     "<p>First <b>bo</b>ld  text<br>next<p>Second &lt;x&gt; text here<aside>box</aside><form>sign<input>up</form></article>"
     "<section class='comments'><p>nice</p></section><footer>foot</footer><script>if(a<b){'</p>'}</script></body></html>",
     "Head & one\n\nFirst bold text next\n\nSecond <x> text here"),
    ("<body><div id=cookie-notice>We use cookies here and there and everywhere</div><article><p>Only this is the text</p></article></body>", "Only this is the text"),
    ("<article><p>Cut off in the mid", "Cut off in the mid"),
    ("<article><p>a &amp b &am", "a & b &am"),
    ("<article></article>", ""),
    (None, ""),
    ("", ""),
]


def test_html(spark):
    rows = [(i, f"u{i}", p, "clash") for i, (p, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0], None), (None, None, PAGES[1][0], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [tuple(r) for r in html_extract.extract(df).collect()]
    want = [(i, f"u{i}", t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(0, "u0", PAGES[0][1], len(PAGES[0][1])), (None, None, PAGES[1][1], len(PAGES[1][1]))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_marks_on_the_page_or_its_article_skip_nothing():
    """Site software marks body, main and article; only parts within them are left out."""
    first, last = " ".join(["first"] * 30), " ".join(["last"] * 30)
    page = (f"<html class='no-sidebar'><body class='has-sidebar menu'><main id='main-menu'><article class='post comments-open'><p>{first}</p>"
            f"<div class='sidebar'>box</div><p>{last}</p></article></main><section class='comments'><article class='comment'><p>nice</p></article>"
            "<article class='comment'><p>me too</p></article></section><footer>foot</footer></body></html>")
    assert html_extract.main_text(page, {}) == f"{first}\n\n{last}"
    assert not {"box", "nice", "me too", "foot"} & {text for _, _, text, _ in html_extract.events(page)}


def test_html_scan_is_the_best_region():
    """The scan's region and sum are those of the greatest sum over all regions, and the text is that of its blocks."""
    rng = random.Random(1)
    names = ("word:p", "word:div", "word:body", "word:li", "tag:p", "tag:/p", "tag:div", "tag:/div", "tag:li", "tag:b")
    seen = set()
    for _ in range(300):
        page = "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "word ", "two words ", "<li>", "<b>", "<nav>menu</nav>"]) for _ in range(14))
        weights = {f: rng.choice([-2.0, -0.5, 0.7, 2.0]) for f in names}
        row = html_extract.events(page)
        scores = list(html_extract.scored(row, weights))
        assert scores == [weights.get(f, html_extract.DEFAULT[f.partition(":")[0]]) * (len(t.split()) if f.startswith("word") else 1) for f, _, t, _ in row]
        regions = [(sum(scores[a:b]), a, b - 1) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        best, first, last = html_extract.best_region(scores)
        top = max([0.0] + [r[0] for r in regions])
        assert best == pytest.approx(top)
        if last < 0:
            assert top == 0 and html_extract.main_text(page, weights) == ""
            continue
        assert sum(scores[first:last + 1]) == pytest.approx(top)
        blocks = range(row[first][1], row[last][1] + 1)
        words = [" ".join("".join(t for _, k, t, _ in row if k == block).split()) for block in blocks]
        assert html_extract.main_text(page, weights) == "\n\n".join(w for w in words if w)
        seen.add((first > 0, last < len(row) - 1))
    assert seen == {(True, True), (True, False), (False, True), (False, False)}


def test_html_pages_of_the_table(spark, smallest):
    """On pages that label their content, the text is that of the article."""
    import re

    pages = spark.read.parquet(f"{smallest}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        import html

        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


# ---- quality ----------------------------------------------------------------

def test_network_reads_every_chunk():
    net = quality.Network.fresh(1)
    rng = random.Random(2)
    texts = ["", "a", "x" * 23, "y" * 24, "ü" * 500, *("".join(chr(rng.randrange(32, 400)) for _ in range(rng.randrange(900))) for _ in range(20))]
    got = net.scores(texts, slice_bytes=300)
    for t, p in zip(texts, got):
        raw = t.encode()
        n = -(-len(raw) // quality.STEP) + 1
        symbols = list(raw) + [quality.PAD] * (n * quality.STEP - len(raw) + quality.STEP)
        top = np.full(quality.FILTERS, -np.inf)
        for i in range(n):
            chunk = net.bytes[symbols[i * quality.STEP:(i + 2) * quality.STEP]].reshape(-1)
            half = len(chunk) // 2
            right = chunk[half:] @ net.right if i + 1 < n else 0
            top = np.maximum(top, chunk[:half] @ net.left + right)
        assert p == pytest.approx(1 / (1 + math.exp(-(np.tanh(top + net.bias) @ net.out[:-1] + net.out[-1]))), abs=1e-4)


def test_training_gradient_lowers_the_loss():
    texts = [("good words here " * 5) if i % 2 else ("bad### junk%%% " * 5) for i in range(64)]
    y = np.array([i % 2 for i in range(64)])
    p = quality.train(texts, y, rounds=6).scores(texts)
    assert ((p >= 0.5) == y).mean() > 0.95


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    network = quality.fit(docs, labels)
    scored = quality.score(docs, network).join(labels, "doc_id").filter(quality.is_held_out("doc_id")).select("quality", "predicted").collect()
    right = sum(r["quality"] == r["predicted"] for r in scored)
    assert len(scored) > 50 and right / len(scored) >= 0.93


def test_quality_edges(spark, corpus, nothing):
    labels = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, quality int")
    assert quality.fit(corpus, labels) is None
    rows = quality.score(corpus, None)
    assert rows.columns.count("score") == 1 and {r["score"] for r in rows.collect()} == {0.5}
    net = quality.Network.fresh(3).to_bytes()
    got = quality.score(corpus, net).collect()
    assert len(got) == corpus.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality.score(nothing, net).count() == 0 and quality.fit(nothing, labels) is None


# ---- repeated passages ------------------------------------------------------

def removed(texts, width):
    words = [words_of(t) for _, t in texts]
    count = collections.Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (key, _), w in zip(texts, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        out.append((key, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [35, 3])
def test_repeats(corpus, texts, width):
    rows = substrings.remove_repeats(corpus, width=width).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows), key=str) == removed(texts, width)
    for r in rows:
        runs = [(x["first"], x["words"]) for x in r["intervals"]]
        assert sum(n for _, n in runs) == r["n_removed"] and all(a + n < b for (a, n), (b, _) in zip(runs, runs[1:]))


def test_without_repeats_keeps_columns(corpus, nothing):
    rows = substrings.without_repeats(corpus)
    assert rows.columns == corpus.columns and rows.count() == corpus.count()
    got = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert got[408].startswith("naïve — 漢字") and got[400] is None and got[203] == ""
    assert substrings.without_repeats(nothing).count() == 0


# ---- suffix tree ------------------------------------------------------------

def plain_tree(texts, depth=2):
    """Scores by dictionaries over all training texts, and the kept contexts of each length."""
    alpha, start = suffix_tree.ALPHA, 1
    rows = [(k, [*words_of(t, lower=True), 0]) for k, t in texts]
    grams = collections.Counter()
    for k, x in rows:
        if fold(k) != 1:
            y = [start, *x]
            for size in range(1, depth + 2):
                grams.update(tuple(y[i:i + size]) for i in range(len(y) - size + 1) if size > 1 or i)
    one = {g[0]: c for g, c in grams.items() if len(g) == 1}
    n, v = sum(one.values()), len(one)
    norm = n + 0.5 * (v + 1)
    times = lambda c: one.get(0, 0) if c == (start,) else grams[c]
    kept = [set() for _ in range(depth + 1)]

    def model(size, before, s):
        if size == 0:
            return (one.get(s, 0) + 0.5) / norm
        c, shorter = tuple(before[-size:]), model(size - 1, before, s)
        return (grams[(*c, s)] + alpha * shorter) / (times(c) + alpha) if len(c) == size and c in kept[size] else shorter

    def left(size, before, s, always=False):
        if size == 0:
            return max(one.get(s, 0) - 0.5, 0.5) / max(norm - 1, 0.5)
        c, shorter = tuple(before[-size:]), left(size - 1, before, s)
        if len(c) == size and (always or c in kept[size]):
            return (max(grams[(*c, s)] - 1, 0) + alpha * shorter) / max(times(c) - 1 + alpha, alpha)
        return shorter

    for size in range(1, depth + 1):
        gains = collections.Counter()
        for g, count in grams.items():
            if len(g) == size + 1 and times(g[:-1]) >= 2:
                gains[g[:-1]] += count * math.log(left(size, g[:-1], g[-1], True) / left(size - 1, g[:-1], g[-1]))
        kept[size] = {c for c in gains if gains[c] >= suffix_tree.GAIN}
    for k, x in rows:
        y = [start, *x]
        total = sum(math.log10(model(depth, y[:p], y[p])) for p in range(1, len(y)))
        yield k, fold(k) == 1, len(x), sum(s in one for s in x), n, sum(math.log10(model(0, [], s)) for s in x), total
    yield kept[1:]


def same_scores(got, want):
    for g, w in zip(got, want, strict=True):
        assert tuple(g[:5]) == w[:5] and tuple(g[5:]) == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_suffix_tree(corpus, texts, depth):
    *want, kept = plain_tree(texts, depth)
    assert all(kept[:2])
    got = sorted((tuple(r) for r in suffix_tree.score(corpus, depth=depth).collect()), key=lambda r: (str(r[0]), r[2]))
    same_scores(got, sorted(want, key=lambda r: (str(r[0]), r[2])))


def test_long_contexts(spark):
    """Texts in which only the words three and four places back tell the next one: contexts of four are kept and help."""
    rng, rows = random.Random(8), []
    for i in range(60):
        x = [rng.randrange(2) for _ in range(4)]
        while len(x) < 40:
            x.append(x[-3] ^ x[-4] if rng.random() < 0.95 else rng.randrange(2))
        rows.append((i, " ".join("ab"[v] for v in x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    totals = {}
    for depth in (2, 4):
        *want, kept = plain_tree(rows, depth)
        got = sorted(tuple(r) for r in suffix_tree.score(df, depth=depth).collect())
        same_scores(got, sorted(want))
        totals[depth] = sum(g[6] for g in got if g[1])
    assert kept[3] and totals[4] > 0.7 * totals[2]


@pytest.mark.parametrize("partitions", ["1", "64"])
def test_suffix_tree_does_not_depend_on_blocks(spark, corpus, texts, monkeypatch, partitions):
    monkeypatch.setattr(suffix_tree.blocks, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(suffix_tree.blocks, "MOST_BYTES", 0)
    monkeypatch.setattr(suffix_tree.blocks, "RANGE_BYTES", 3000)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    *want, _ = plain_tree(texts)
    got = sorted((tuple(r) for r in suffix_tree.score(corpus).collect()), key=lambda r: (str(r[0]), r[2]))
    same_scores(got, sorted(want, key=lambda r: (str(r[0]), r[2])))


def test_suffix_tree_of_nothing_leaves_nothing_behind(spark, nothing):
    tables = {t.name for t in spark.catalog.listTables()}
    assert suffix_tree.score(nothing).count() == 0
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_pairs_of_frequent_words_are_states(spark):
    """A pair that comes hardly more often than its parts suggest is kept if what follows it differs."""
    rows = [(i, "of the x q the y of r x r the y q of r") for i in range(40)]
    *want, kept = plain_tree(rows)
    assert tuple(words_of("of the")) in kept[1]
    got = sorted(tuple(r) for r in suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    same_scores(got, sorted(want))


def test_suffix_tree_without_training(spark):
    keys = [k for k in range(100) if fold(k) == 1][:3]
    got = suffix_tree.score(spark.createDataFrame([(k, "a b") for k in keys], "doc_id long, text string")).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got) and len(got) == 3


# ---- mixing -----------------------------------------------------------------

def sainte_lague(votes, seats, cap):
    won = dict.fromkeys(votes, 0)
    heap = [(-v, k, 0) for k, v in votes.items() if v > 0 and cap[k] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, k, n = heapq.heappop(heap)
        won[k] = n + 1
        if n + 1 < cap[k]:
            heapq.heappush(heap, (-votes[k] / (2 * n + 3), k, n + 1))
    return won


def test_apportionment(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    for n, seats in ((1, 7), (5, 0), (9, 31), (40, 200), (6, 5)):
        votes = {f"p{i:02}": rng.choice([0, 3, 10, 77, 900.5, 4000]) for i in range(n)}
        cap = {k: rng.randrange(0, 3 * seats + 2) if rng.random() < 0.3 else 10**6 for k in votes}
        df = spark.createDataFrame([(0, k, float(v), cap[k]) for k, v in votes.items()], "g int, k string, v double, most long")
        got = {r["k"]: r["quota"] for r in mixing.apportion(df, ["g"], ["k"], "v", F.lit(seats), F.col("most")).collect()}
        if all(c == 10**6 for c in cap.values()):
            assert got == sainte_lague(votes, seats, cap)
        assert all(q <= cap[k] for k, q in got.items()) and sum(got.values()) <= seats


def water(sizes, most=3):
    """Targets by taking full sources out one after the other."""
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        over = [s for s in open_ if level * weights[s] > most * sizes[s]]
        if not over:
            return target | {s: level * weights[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("shard_docs", [20_000, 7])
def test_mix(corpus, texts, shard_docs):
    rows = mixing.mix(corpus, shard_docs=shard_docs, block=4).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(k), len(words_of(t))) for k, t in texts)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(x["words"] for x in r["runs"])
    target = water(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(12, 0.05 * target[s])
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    again = mixing.mix(corpus.repartition(5), shard_docs=shard_docs, block=4).collect()
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_mixed_rows(corpus, nothing):
    rows = mixing.mixed(corpus, block=4)
    assert rows.columns == corpus.columns
    want = sum(r["taken"] for r in mixing.mix(corpus, block=4).collect())
    assert sum(len(words_of(r["text"])) for r in rows.collect()) == want
    assert mixing.mixed(nothing).count() == 0 and mixing.mix(nothing).count() == 0


# ---- sharding ---------------------------------------------------------------

def test_lpt_is_the_greedy_rule():
    rng = random.Random(8)
    items = [(f"i{i}", rng.randrange(1, 50)) for i in range(80)]
    loads, where = [0] * 5, {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        s = loads.index(min(loads))
        loads[s] += size
        where[name] = s
    assert dict(sharding.lpt(items, 5)) == where


def test_shards(corpus, texts, nothing):
    rows = sharding.shard(corpus).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted(
        (str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts)
    of_text = collections.defaultdict(set)
    slots, loads = collections.defaultdict(list), collections.Counter()
    for r in rows:
        of_text[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = collections.Counter()
    for _, t in texts:
        largest[t or ""] += len((t or "").encode()) + 1
    assert max(loads.values()) - min(loads.values()) <= max(largest.values())
    assert sharding.shard(nothing).count() == 0


# ---- near duplicates --------------------------------------------------------

def near(texts, share=80):
    sets = []
    for _, t in texts:
        w = words_of(t, lower=True)
        sets.append(frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and texts[i][0] is not None and texts[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                    group[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(texts):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [(k, len(s), least.get(root(i)), k == least.get(root(i))) for i, ((k, _), s) in enumerate(zip(texts, sets))]


@pytest.mark.parametrize("tile", [512, 8])
def test_near_documents(corpus, texts, tile, monkeypatch):
    """Small tiles and quotas take the same links as large ones."""
    monkeypatch.setattr(odd_sketch, "TILE", tile)
    if tile == 8:
        monkeypatch.setattr(odd_sketch, "QUOTAS", (1, None))
    got = sorted((tuple(r) for r in odd_sketch.near_duplicates(corpus).collect()), key=str)
    assert got == sorted(near(texts), key=str)


def test_near_documents_of_nothing(nothing):
    assert odd_sketch.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("size", [1, 4, 9, 45, 150, 900, 5000, 40_000])
def test_sketches_lose_no_pair(size):
    """Pairs at the threshold stay; dissimilar ones go, but for texts so long that their bitmaps are full."""
    rng = np.random.default_rng(size)
    kept = dropped = 0
    for _ in range(60 if size < 5000 else 8):
        shared, rest = size - size // 9, size // 9  # similarity (size - size // 9) / (size + size // 9): 0.8 or a little more
        x = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([rng.permutation(x)[:shared], rng.integers(0, 1 << 63, rest, np.uint64) * np.uint64(2)]))
        z = np.unique(np.concatenate([rng.permutation(x)[:size // 2], rng.integers(0, 1 << 63, size - size // 2, np.uint64) * np.uint64(2)]))
        both = len(np.intersect1d(x, y))
        assert 100 * both >= 80 * (len(x) + len(y) - both)

        def may(p, q):
            (a, f), (b, g) = odd_sketch.odd_sketch(p), odd_sketch.odd_sketch(q)
            return np.bitwise_count(f ^ g).sum() <= odd_sketch.most_bits(np.array([len(p)]), np.array([len(q)]), a, b, 0.8)[0]

        kept += bool(may(x, y))
        dropped += not may(x, z)
    assert kept == (60 if size < 5000 else 8)
    assert size < 45 or size > 5000 or dropped == kept


def test_sketch_filter_misses_one_in_a_million_at_most():
    """Each of the two estimates of the filter, by the normal law."""
    assert math.erfc(odd_sketch.ERRORS / math.sqrt(2)) / 2 < 3e-7


# ---- byte BPE ---------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_a_worker_keeps_no_pieces_of_an_ended_task(spark, corpus):
    """Nothing that a task has learned stays in its Python worker, which goes on to other stages."""
    docs = corpus.select("doc_id", "text").repartition(8)
    byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN).write.format("noop").mode("overwrite").save()
    byte_bpe.digests(docs, PATH, public_tokenizers.PATTERN).write.format("noop").mode("overwrite").save()

    def held(batches):
        for batch in batches:
            ranks = byte_bpe.ranks_of(PATH)
            yield pa.RecordBatch.from_pydict({"n": [len(ranks.memory) + len(ranks.older)] * len(batch)})

    assert spark.range(64).repartition(16).mapInArrow(held, "n long").groupBy().max("n").first()[0] == 0


def test_encoding(corpus, texts, library, nothing):
    want = sorted(((k, len(ids := library.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest()) for k, t in texts), key=str)
    got = sorted((tuple(r) for r in byte_bpe.digests(corpus, PATH, public_tokenizers.PATTERN).collect()), key=str)
    assert got == want
    rows = byte_bpe.decode(byte_bpe.encode(corpus, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows)
    assert byte_bpe.digests(nothing, PATH, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.encode(nothing, PATH, public_tokenizers.PATTERN).count() == 0


def test_merging_odd_pieces(library):
    rng = random.Random(5)
    ranks, cut = byte_bpe.ranks_of(PATH), byte_bpe.pattern_of(public_tokenizers.PATTERN)
    texts = ["a" * 5000, " " * 700 + "x", "abc" * 900, "ab" * 64, "\n\n\n  x", "é" * 300]
    texts += ["".join(rng.choice("abcdething ") for _ in range(rng.randrange(400))) for _ in range(300)]
    texts += ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(200)) for _ in range(50)]
    for t, ids in zip(texts, ranks.encode(texts, cut)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert ranks.decode(ids) == t.encode()


# ---- memory -----------------------------------------------------------------

def test_tables_of_powers_stay_small():
    """However long a text or a block, the tables of powers reach over one chunk of it and no more."""
    from surco.llm import words

    rng = random.Random(6)
    texts = [" ".join(str(rng.randrange(900)) for _ in range(n)) for n in (700_000, 3, 200_000)]
    whole = Words(texts)
    hashes, at = whole.windows(35)
    assert max(len(p.up) for p in (words._IN_WORD, words._IN_WINDOW)) <= 2 * words._CHUNK
    for i in (0, 1, 524_253, 524_254, 600_000, len(hashes) - 1):
        assert hashes[i] == rolling(whole.hashes[at[i]:at[i] + 35], 35)[0]


@pytest.mark.parametrize("partitions", ["1", "64"])
def test_repeats_do_not_depend_on_blocks(spark, corpus, monkeypatch, partitions):
    """One block or many, and slices of a few bytes: the same intervals."""
    def told():
        rows = substrings.remove_repeats(corpus, width=5).select("doc_id", "n_words", "n_removed", "intervals", "kept_sha256")
        return sorted(map(str, rows.collect()))

    want = told()
    monkeypatch.setattr(substrings.blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(substrings.blocks, "MOST_BYTES", 0)
    monkeypatch.setattr(substrings.blocks, "RANGE_BYTES", 3000)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert told() == want


def test_parts_of_a_batch_are_whole_rows():
    import pyarrow as pa

    from surco.llm.words import in_parts

    texts = ["abc", None, "", "x" * 50, "yy", "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["a", "t"])
    for most in (1, 4, 1000):
        parts = list(in_parts([batch, batch.slice(0, 0)], 1, most))
        assert [x for p in parts for x in p.column(1).to_pylist()] == texts
        assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= most for p in parts)


def test_pairs_at_the_threshold_are_not_missed():
    """Random sets at a similarity of 0.8 or just above: none without a shared band, none that its sketches rule out."""
    rng = np.random.default_rng(12)
    bands_of = lambda s: (odd_sketch.minhashes(s).reshape(odd_sketch.BANDS, odd_sketch.ROWS))
    shared, missed = [], 0
    for _ in range(1200):
        union = int(np.exp(rng.uniform(np.log(9), np.log(3000))))
        both = -(-80 * union // 100)
        pool = np.sort(rng.integers(0, 1 << 63, union, np.uint64))
        rest = rng.permutation(union)
        one = rng.integers(0, union - both + 1)
        common, mine, yours = rest[:both], rest[both:both + one], rest[both + one:]
        a, b = np.unique(pool[np.concatenate((common, mine))]), np.unique(pool[np.concatenate((common, yours))])
        shared.append(int((bands_of(a) == bands_of(b)).all(axis=1).sum()))
        (na, sa), (nb, sb) = odd_sketch.odd_sketch(a), odd_sketch.odd_sketch(b)
        bits = int(np.bitwise_count(sa ^ sb).sum())
        most = odd_sketch.most_bits(*(np.array([v]) for v in (len(a), len(b), na, nb)), 0.8)[0]
        missed += shared[-1] == 0 or bits > most
    assert missed == 0 and 11 < np.mean(shared) < 15
