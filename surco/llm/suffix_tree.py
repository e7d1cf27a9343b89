"""Language-model scores from a probabilistic suffix tree over words.

The states of the tree are the empty context and contexts of up to `depth`
tokens. A context is kept only if it passes a divergence test against its
suffix: summed over the training text, with each occurrence left out of its own
counts, its next-symbol distribution must gain over that of its longest kept
suffix by GAIN nats. A context seen once cannot gain, as its only occurrence is
left out. A kept state's distribution is smoothed towards its suffix's, down to
the base of all tokens. Every token is scored by the longest kept context before it.

Counts of all sequences are exact over the training texts, level by level. They
stay in ranges of keys; every block of documents gets the counts of its own keys,
so no task and no driver holds the tree. Each round's answers are written to the
shared folder, and its key shuffle goes before the next round begins. Sequences
are known by hashes of BITS bits; two share a count by chance once in 2^BITS pairs.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import blocks
from .links import removed, shared_folder
from .words import Words, mix

ALPHA, GAIN = 2.0, 3.0
BITS = 54
# Tokens of the longest contexts.
DEPTH = 2
# Gains are summed as whole numbers of this part of a nat, so that no order of additions shows.
GRAIN = 1 << 24
_CUT = np.uint64(64 - BITS)
# Kinds of messages: totals, and per length the counts of sequences and the gains of contexts.
TOTAL = 0
_END, _START = mix(np.array([101, 202], np.uint64)) >> _CUT
SENT = "kind int, block long, part int, keys binary, counts binary"


def _gram(length: int) -> int:
    return 2 * length


def _gain(length: int) -> int:
    return 2 * length + 1


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a ^ mix(b + np.uint64(0x632BE59BD9B4E019))) >> _CUT


class Unique:
    """Distinct keys of some tokens, sorted, and values per key spread over those tokens."""

    def __init__(self, keys: np.ndarray, where: np.ndarray):
        self.where = np.flatnonzero(where)
        self.keys, self.at = np.unique(keys[where], return_inverse=True)
        self.size = len(where)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=x[self.where], minlength=len(self.keys))

    def spread(self, values: np.ndarray, otherwise=0) -> np.ndarray:
        out = np.full(self.size, otherwise, np.float64)
        out[self.where] = values[self.at]
        return out


class Block:
    """The tokens of a block, with what is known of their counts so far."""

    def __init__(self, pieces: pa.Table, answers: pa.Table | None = None):
        self.rows = rows = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in pieces.column("rows")])
        self.number = pieces.column("block")[0].as_py()
        self.held_out = np.array([bool(h) for h in rows.column("held_out").to_pylist()])
        words = Words(rows.column("text").to_pylist(), lower=True)
        self.texts = len(self.held_out)
        n_words = words.counts()
        total = len(words.hashes) + self.texts
        self.first = words.offsets[:-1] + np.arange(self.texts)
        self.n_tokens = n_words + 1
        token = np.full(total, _END)
        last = self.first + n_words
        is_word = np.ones(total, bool)
        is_word[last] = False
        token[is_word] = words.hashes >> _CUT
        del words
        self.token = token
        self.train = np.repeat(~self.held_out, self.n_tokens)
        self.place = np.arange(total) - np.repeat(self.first, self.n_tokens)
        self.tokens = Unique(token, np.ones(total, bool))
        self.answers = answers

    def numbers(self, kind: int, unique: Unique) -> np.ndarray:
        parts = [blocks.unpack_numbers(a[16:] if kind == _gram(1) else a) for a in blocks.answers_of(self.answers, kind)]
        out = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        if len(out) != len(unique.keys):
            raise ValueError(f"{len(unique.keys)} keys, {len(out)} answers of kind {kind}")
        return out.astype(np.float64)

    def with_tokens(self) -> Block:
        """Counts of tokens are known: the base, and contexts of one token."""
        totals = [np.frombuffer(a[:16], "<i8") for kind in (_gram(1), TOTAL) for a in blocks.answers_of(self.answers, kind)]
        totals = np.array(totals).sum(axis=0)
        self.n, self.v = (float(x) for x in (totals if totals.size else (0, 0)))
        self.count = self.tokens.spread(self.numbers(_gram(1), self.tokens))
        norm = self.n + 0.5 * (self.v + 1)
        self.base = (self.count + 0.5) / norm
        # The distribution of the longest kept context so far, and the same with this occurrence left out.
        self.model, self.model_left = self.base, np.maximum(self.count - 0.5, 0.5) / max(norm - 1, 0.5)
        before = np.concatenate((self.token[:1], self.token[:-1]))
        before[self.first] = _START
        at = np.flatnonzero(self.token == _END)
        counts = np.concatenate((self.count[:1], self.count[:-1]))
        counts[self.first] = self.count[at[0]] if len(at) else 0.0  # training texts: as many as ends
        self._contexts(1, before, counts)
        return self

    def _contexts(self, length: int, keys: np.ndarray, counts: np.ndarray) -> None:
        """Contexts of `length` tokens before each token; those that come once cannot gain and are not counted further."""
        self.length, self.context_key, self.context = length, keys, counts
        self.tested = (self.place >= length - 1) & (counts >= 2)
        self.counted = self.tested & (self.count >= 1)
        self.gram_key = _pair(keys, self.token)
        self.grams = Unique(self.gram_key, self.counted)

    def with_grams(self) -> Block:
        """Counts of sequences of one more token are known."""
        self.gram_count = self.grams.spread(self.numbers(_gram(self.length + 1), self.grams))
        self.contexts = Unique(self.context_key, self.tested)
        self.next_left = (np.maximum(self.gram_count - 1, 0) + ALPHA * self.model_left) / np.maximum(self.context - 1 + ALPHA, ALPHA)
        return self

    def gains(self) -> np.ndarray:
        gain = np.where(self.train & self.counted, np.log(self.next_left / self.model_left), 0.0)
        return self.contexts.sums(np.rint(gain * GRAIN)).astype(np.int64)

    def with_states(self) -> Block:
        """It is known which contexts of this length are kept; contexts of one more token come next."""
        kept = self.contexts.spread(self.numbers(_gain(self.length), self.contexts)) > 0
        self.model = np.where(kept, (self.gram_count + ALPHA * self.model) / (self.context + ALPHA), self.model)
        self.model_left = np.where(kept, self.next_left, self.model_left)
        return self

    def longer(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of the contexts of one more token."""
        return (np.concatenate((x[:1], x[:-1])) for x in (self.gram_key, self.gram_count))

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score of every text."""
        add = lambda x: np.add.reduceat(x, self.first)
        return add((self.count > 0).astype(np.int64)), add(np.log10(self.base)), add(np.log10(self.model))


def _messages(b: Block, step: int, depth: int, parts: int) -> pa.Table:
    """What a block sends in a round, from what it knows by then: gains of contexts and counts of longer sequences.

    Round 0 counts tokens, round 1 pairs; round r tells the gains of contexts of
    r - 1 tokens and counts sequences of r + 1, the last one gains only.
    """
    pa.default_memory_pool().release_unused()  # what the last block left
    if step == 0:
        return pa.Table.from_batches([_send(_gram(1), b.number, b.tokens.keys, b.tokens.sums(b.train), parts)])
    b.with_tokens()
    for _ in range(step - 2):
        keys, counts = _advance(b)
        b._contexts(b.length + 1, keys, counts)
    if step == 1:
        return pa.Table.from_batches([_send(_gram(2), b.number, b.grams.keys, b.grams.sums(b.train), parts)])
    b.with_grams()
    out = [_send(_gain(b.length), b.number, b.contexts.keys, b.gains(), parts)]
    if step <= depth:
        b._contexts(b.length + 1, *b.longer())
        out.append(_send(_gram(b.length + 1), b.number, b.grams.keys, b.grams.sums(b.train), parts))
    return pa.Table.from_batches(out)


def _advance(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Past the contexts of one length: which are kept, and what longer ones there are."""
    b.with_grams().with_states()
    keys, counts = b.longer()
    return keys, counts


def _send(kind: int, block: int, keys: np.ndarray, values: np.ndarray, parts: int) -> pa.RecordBatch:
    rows = blocks.packed(block, keys, None, parts, BITS)
    cuts = np.cumsum([0, *(len(blocks.unpack_keys(k)) for k in rows.column("keys").to_pylist())])
    values = values.astype(np.int64)
    values = ((values << 1) ^ (values >> 63)).astype(np.uint64) if kind % 2 else values.astype(np.uint64)  # gains may be negative
    packed = [blocks.pack_numbers(values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(rows), pa.int32()), rows.column("block"), rows.column("part"), rows.column("keys"), pa.array(packed, pa.binary())],
        names=["kind", "block", "part", "keys", "counts"])


def _reply(table: pa.Table, n_blocks: int) -> pa.Table:
    """Sums over all blocks: counts as they are, gains as whether they reach GAIN; every block gets the totals of all tokens."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    gains = kind % 2 == 1
    keys = [blocks.unpack_keys(x) for x in table.column("keys").to_pylist()]
    values = np.concatenate([blocks.unpack_numbers(x) for x in table.column("counts").to_pylist()])
    values = (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64) if gains else values.astype(np.int64)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    sums = np.add.reduceat(values[order], first)
    spread = np.empty(len(flat), np.uint64)
    spread[order] = np.repeat((sums >= GAIN * GRAIN).astype(np.uint64) if gains else sums.astype(np.uint64), np.diff(np.append(first, len(flat))))
    to, kinds, out = table.column("block").to_pylist(), [kind] * len(keys), [blocks.pack_numbers(x) for x in np.split(spread, cuts)]
    if kind == _gram(1):
        total = np.array([sums.sum(), (sums > 0).sum()], "<i8").tobytes()
        others = sorted(set(range(n_blocks)) - set(to))  # blocks without a key in this range
        to, kinds, out = to + others, kinds + [TOTAL] * len(others), [total + x for x in out] + [total] * len(others)
    return pa.table({
        "block": pa.array(to, pa.int64()), "kind": pa.array(kinds, pa.int32()), "part": pa.array([part] * len(to), pa.int32()), "answer": pa.array(out, pa.binary())})


class _Tables:
    """What one run writes to the shared folder: documents dealt by block, which no later round shuffles again, and small answers."""

    def __init__(self, spark: SparkSession, partitions: int):
        self.spark, self.partitions = spark, partitions
        self.name = f"surco_{uuid.uuid4().hex}"
        self.folder = f"{shared_folder(spark)}/{self.name}"
        self.files = 0

    def dealt(self, df: DataFrame) -> DataFrame:
        df = df.repartition(self.partitions, "block")
        df.write.bucketBy(self.partitions, "block").option("path", f"{self.folder}/dealt").saveAsTable(self.name)
        return self.spark.table(self.name)

    def put(self, df: DataFrame) -> DataFrame:
        self.files += 1
        df.write.parquet(path := f"{self.folder}/{self.files}")
        return self.spark.read.parquet(path)

    def let_go(self) -> None:
        """Shuffles that nothing refers to any more leave the disks once the driver has noticed."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        removed(self.spark, self.folder)


def score(df: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, fold: int = 1, depth: int = DEPTH) -> DataFrame:
    """One row per row of `df`: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose key, as text, leaves `fold` by CRC-32 are held out of training; a null
    key is not. Texts are lower-cased from A to Z, cut into words, and closed by one
    end; a null or empty text is its end alone. Scores are log10 probabilities.
    Contexts have at most `depth` tokens, 1 or more. Rows that repeat count as often
    as they are there. Without training texts every token is unknown.
    """
    if depth < 1:
        raise ValueError("depth must be 1 or more")
    spark = df.sparkSession
    partitions, n_blocks, parts = blocks.sizes(df, text)
    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))
    rows = df.select(F.col(key).alias("key"), held.alias("held_out"), F.col(text).alias("text"))
    block = F.pmod(F.xxhash64("key", "text"), F.lit(n_blocks)).cast("long")

    def pack(batches):
        """The documents of a batch that go to one block, as one compressed piece."""
        how = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            to = batch.column(0).to_numpy()
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
            pieces = []
            for at in np.split(order, cuts[1:]) if len(order) else []:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest := batch.schema.remove(0), options=how) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([c.take(pa.array(at)) for c in batch.columns[1:]], schema=rest))
                pieces.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(to[order[cuts]] if len(order) else [], pa.int64()), pa.array(pieces, pa.binary())], names=["block", "rows"])

    def sums(table: pa.Table) -> pa.Table:
        return _reply(table, n_blocks)

    def round_of(step: int):
        def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
            return _messages(Block(rows, answers), step, depth, parts) if len(rows) else _nothing()

        return send

    def send_tokens(rows: pa.Table) -> pa.Table:
        return _messages(Block(rows), 0, depth, parts)

    kind = dict(rows.dtypes)["key"]
    result = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    empty = pa.table({n: pa.array([], t) for n, t in (
        ("key", to_arrow_type(rows.schema["key"].dataType)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(rows):  # totals went to a block without documents
            return empty
        b = Block(rows, answers).with_tokens()
        for length in range(1, depth + 1):
            keys, counts = _advance(b)
            if length < depth:
                b._contexts(length + 1, keys, counts)
        known, base, model = b.scores()
        return pa.table({
            "key": b.rows.column("key"), "held_out": b.rows.column("held_out"), "n_tokens": pa.array(b.n_tokens.astype(np.int64)), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(b.texts, int(b.n))), "base_score": pa.array(base), "score": pa.array(model)})

    tables = _Tables(spark, partitions)
    own = tables.dealt(rows.select(block.alias("block"), *rows.columns).mapInArrow(pack, "block long, rows binary")).groupBy("block")
    known: DataFrame | None = None
    for step in range(depth + 2):
        tables.let_go()
        sent = own.cogroup(known.groupBy("block")).applyInArrow(round_of(step), SENT) if known else own.applyInArrow(send_tokens, SENT)
        told = tables.put(sent.groupBy("kind", "part").applyInArrow(sums, blocks.ANSWERS))
        known = told if known is None else known.unionByName(told)
        del sent, told
    scored = f"{tables.folder}-scores"
    own.cogroup(known.groupBy("block")).applyInArrow(finish, result).write.parquet(scored)
    tables.drop()
    return spark.read.parquet(scored).withColumnRenamed("key", key)


def _nothing() -> pa.Table:
    return pa.table({"kind": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "part": pa.array([], pa.int32()),
                     "keys": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
