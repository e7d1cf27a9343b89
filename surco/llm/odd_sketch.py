"""Near-duplicate documents by MinHash bands and odd sketches.

A document's set is its distinct shingles of words. Equal sets are one class.
Classes that agree in a band of MinHash values are candidates. An odd sketch, a
bitmap in which every MinHash value flips one bit, tells by the bits in which two
sketches differ whether a pair can be similar enough; pairs that can are
confirmed on their full sets. As components are asked for, a bucket gives each
member's best partners first, and later only pairs whose classes are not yet
connected, so no bucket emits all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import arrow_rows, components, kept
from .words import Words, in_parts, mix, rolling

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
# Bins of the one-permutation MinHash samples that a sketch folds, and its bits. Texts of more than
# some ten thousand shingles fill the bitmap: it then rules nothing out, and the full sets decide.
BINS, BITS = 1 << 16, 2048
# Standard errors of the sketch's estimate by which a pair may stay below the threshold.
ERRORS = 5.0
# Members of a bucket that one task compares with others.
TILE = 512
# Partners of a class per bucket in each round; the last takes all that are left.
QUOTAS = (2, None)

_RNG = np.random.default_rng(11)
_FACTORS = _RNG.integers(1, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _RNG.integers(0, 1 << 63, SAMPLES, np.uint64)
_ROW_SALTS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's runs of `width` words; of all its words if it has fewer."""
    words = Words(texts, lower=True)
    runs = rolling(words.hashes, width)
    salt = mix(np.array([width], np.uint64))
    for a, b in zip(words.offsets, words.offsets[1:], strict=False):
        if b - a >= width:
            yield np.unique(runs[a:b - width + 1] ^ salt)
        elif b > a:
            yield rolling(words.hashes[a:b], int(b - a)) ^ mix(np.array([b - a], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 512):
        np.minimum(low, (shingles[i:i + 512, None] * _FACTORS + _ADDED).min(axis=0), out=low)
    return low


def odd_sketch(shingles: np.ndarray) -> tuple[int, np.ndarray]:
    """How many bins have a sample, the least hash of the bin, and the bitmap of the parities of the samples' hashes."""
    bins = shingles >> np.uint64(64 - (BINS - 1).bit_length())
    samples = shingles[np.concatenate(([True], bins[1:] != bins[:-1]))]
    at = (mix(samples ^ _ROW_SALTS[0]) % np.uint64(BITS)).astype(np.int64)
    return len(samples), np.packbits(np.bincount(at, minlength=BITS).astype(np.uint8) & 1)


def most_bits(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """The largest number of differing bits of sets of n and m shingles, with a and b samples, that may be as similar as `share`.

    Below zero where the sizes alone rule it out.
    """
    n, m = np.minimum(n, m).astype(float), np.maximum(n, m).astype(float)
    both = share * (n + m) / (1 + share)
    union = n + m - both
    bins = BINS * -np.expm1(union * np.log1p(-1 / BINS))
    similar = both / union
    # A shared shingle is a shared sample unless another shingle of its bin is less.
    spread = np.sqrt(np.minimum(similar * (1 - similar) * bins, np.maximum(both - similar * bins, 0)))
    shared = np.maximum(0, similar * bins - ERRORS * spread - 1)
    flips = np.maximum(0, a + b - 2 * shared)
    mean = BITS / 2 * -np.expm1(flips * np.log1p(-2 / BITS))
    once, twice = np.exp(2 * flips * np.log1p(-2 / BITS)), np.exp(flips * np.log1p(-4 / BITS))
    variance = BITS / 4 * (1 - once) + BITS * (BITS - 1) / 4 * (twice - once)
    return np.where(n < share * m, -1, mean + ERRORS * np.sqrt(np.maximum(variance, 0)) + 1)


def signatures(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    kind = dict(df.dtypes)[key]
    schema = f"key {kind}, n_shingles long, digest binary, bands array<long>, samples int, sketch binary"

    def run(batches):
        for batch in in_parts(batches, 1):
            out: list[tuple] = []
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                if not len(s):
                    out.append((0, None, None, None, None))
                    continue
                samples = minhashes(s)
                bands = mix((samples.reshape(BANDS, ROWS) * _ROW_SALTS[:ROWS]).sum(axis=1, dtype=np.uint64) ^ _ROW_SALTS[:BANDS])
                taken, sketch = odd_sketch(s)
                out.append((len(s), hashlib.md5(s.tobytes()).digest(), bands.view(np.int64), taken, sketch.tobytes()))
            n, digest, bands, taken, sketch = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                pa.array(taken, pa.int32()), pa.array(sketch, pa.binary()),
            ], names=["key", "n_shingles", "digest", "bands", "samples", "sketch"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def _best(pairs: list[tuple[np.ndarray, ...]], quota: int | None, small: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pairs that are among the `quota` nearest of a small member."""
    i, j, far = (np.concatenate(x) for x in zip(*pairs, strict=True))
    if quota is None:
        return i, j, far
    who, which = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    asks = small[who]
    who, which = who[asks], which[asks]
    order = np.lexsort((which, far[which], who))
    who, which = who[order], which[order]
    first = np.concatenate(([True], who[1:] != who[:-1])) if len(who) else np.empty(0, bool)
    rank = np.arange(len(who)) - np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))
    keep = np.unique(which[rank < quota])
    return i[keep], j[keep], far[keep]


def _near(rows: dict[str, np.ndarray], quota: int | None, share: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of a group, one of them own and one small, of different components, by sketches; each group's own rows come first."""
    group, own, small, comp, n, taken, sketch = (rows[c] for c in ("group", "own", "small", "comp", "n", "samples", "sketch"))
    bucket, bands = rows["bucket"], rows["bands"]
    last = np.searchsorted(group, group, side="right")
    i = np.flatnonzero(own)
    found: list[tuple[np.ndarray, ...]] = []
    size, step = 0, 0
    while len(i):
        step += 1
        i = i[i + step < last[i]]
        j = i + step
        use = (small[i] | small[j]) & (comp[i] != comp[j])
        a, b = i[use], j[use]
        bits = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(bits <= most_bits(n[a], n[b], taken[a], taken[b], share))
        first = (bands[a[near]] == bands[b[near]]).argmax(axis=1)
        near = near[bands[a[near], first] == bucket[a[near]]]
        found.append((a[near], b[near], bits[near] / (n[a] + n[b])[near]))
        size += len(near)
        if size > 200_000:
            best = _best(found, quota, small)
            found, size = ([best], 0) if quota is not None else ([], 0)
            if quota is None:
                yield best
    if found:
        yield _best(found, quota, small)


def near_pairs(members: DataFrame, quota: int | None, share: float) -> DataFrame:
    """Candidate pairs `u, v` from rows bucket, tile, node, comp, small, own, n_shingles, bands, samples, sketch.

    Members that share several buckets are compared in the first of them only.
    """
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(partitions, "bucket", "tile").sortWithinPartitions("bucket", "tile", F.desc("own"), "node")

    def pairs_of(rows: pa.Table):
        bucket, tile = rows.column("bucket").to_numpy(), rows.column("tile").to_numpy()
        change = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])))
        known = {"group": np.cumsum(change), "n": rows.column("n_shingles").to_numpy(), "samples": rows.column("samples").to_numpy().astype(np.int64)}
        known |= {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("own", "small")}
        known["comp"] = rows.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        known |= {"bucket": bucket, "bands": rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)}
        known["sketch"] = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        node = rows.column("node").combine_chunks()
        for i, j, _ in _near(known, quota, share):
            if len(i):
                yield pa.RecordBatch.from_arrays([node.take(pa.array(i)), node.take(pa.array(j))], names=["u", "v"])

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            bucket, tile = held.column("bucket").to_numpy(), held.column("tile").to_numpy()
            cut = len(bucket) - int(np.argmax(((bucket != bucket[-1]) | (tile != tile[-1]))[::-1])) if (bucket[0], tile[0]) != (bucket[-1], tile[-1]) else 0
            if cut:
                yield from pairs_of(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and len(held):
            yield from pairs_of(held.combine_chunks())

    found = dealt.mapInArrow(run, "u binary, v binary")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= share * union."""
    first = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = first.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= share * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "u binary, v binary")


def _settled(df: DataFrame, key: str, text: str, width: int, share: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, the classes of equal sets, and the components of the classes that links reach."""
    rows = kept(signatures(df, key, text, width))
    n = rows.count()
    classes = rows.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "samples", "sketch")])
    classes = classes.filter(F.col("key").isNotNull())
    buckets = classes.select("digest", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    members = buckets.join(sizes, "bucket").select("bucket", F.col("digest").alias("node"), tiles.alias("tiles"))
    members = kept(members.withColumn("home", F.pmod(F.xxhash64("node", F.lit(3)), F.col("tiles")).cast("int")), 4 * n)
    nodes = members.select("node").distinct()
    of_nodes = classes.join(nodes, F.col("digest") == F.col("node"), "left_semi")
    sketches = kept(of_nodes.select(F.col("digest").alias("node"), "key", "n_shingles", "bands", "samples", "sketch"), n)
    sets = kept(_sets(df, sketches, key, text, width), 4 * n)

    comps: DataFrame | None = None
    for quota in QUOTAS:
        if comps is None:
            here = members.withColumns({"tile": F.col("home"), "comp": F.col("node"), "small": F.lit(True), "own": F.lit(True)})
        else:
            here = _unsettled(members, comps)
        found = near_pairs(here.join(sketches.drop("key"), "node"), quota, share / 100)
        links = confirmed(found, sets, share)
        if comps is not None:
            links = links.unionByName(comps.select(F.col("node").alias("u"), F.col("component").alias("v")))
        comps = components(links, n)
    return rows, classes, comps


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, share: int = 80) -> DataFrame:
    """One row per row of `df`: key, n_shingles, component_id, kept.

    Rows link with 100 * intersection >= share * union of their sets; a text
    without words links with nothing. `component_id` is the least key that links
    reach, the row's own included; `kept` says that it is the row's own. Equal
    texts, also rows that repeat a key, are one class. Rows without a key take
    part only as copies of others; alone, their component is null and they are kept.
    """
    with arrow_rows(df.sparkSession, 512):
        rows, classes, comps = _settled(df, key, text, width, share)

    # A class that no link reaches is a component of its own.
    keys = classes.select("digest", "key").join(comps, F.col("digest") == F.col("node"), "left")
    keys = keys.select("digest", "key", F.coalesce("component", "digest").alias("component"))
    least = keys.groupBy("component").agg(F.min("key").alias("component_id"))
    found = keys.join(least, "component").select(F.col("digest").alias("d"), "component_id")
    out = rows.select("key", "n_shingles", "digest").join(found, F.col("digest") == F.col("d"), "left")
    own = F.when(F.col("n_shingles") == 0, F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), "n_shingles", own.alias("component_id"), F.col("key").eqNullSafe(own).alias("kept"))


def _unsettled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: all in their own tile, those outside the bucket's largest component in every tile."""
    rows = members.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    counts = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("main")).filter("comps > 1")
    rows = rows.join(main, "bucket").withColumn("small", F.col("comp") != F.col("main"))
    everywhere = F.when(F.col("small"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("home"))
    rows = rows.withColumn("tile", F.explode(everywhere))
    return rows.select("bucket", "node", "tile", "comp", "small", (F.col("tile") == F.col("home")).alias("own"))


def _sets(df: DataFrame, nodes: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """`node, shingles` for the classes that have candidates, from the text of the class's least key."""
    wanted = nodes.select("node", F.col("key").alias("wanted"))
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("text")).join(wanted, F.col("k") == F.col("wanted")).select("node", "text")

    def run(batches):
        for batch in in_parts(batches, 1):
            node = batch.column("node").to_pylist()
            sets = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), width)]
            mine = [hashlib.md5(s).digest() == n for s, n in zip(sets, node, strict=True)]  # a repeated key may have another text
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"]).filter(pa.array(mine, pa.bool_()))

    return rows.mapInArrow(run, "node binary, shingles binary").dropDuplicates(["node"])
