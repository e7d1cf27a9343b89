"""Removal of passages that occur more than once.

Rabin-Karp hashes of every window of `width` words are counted over all
documents. Every word that a repeated window covers goes; windows that follow
one another merge into maximal intervals. Windows are judged on the input, so
the first occurrence goes as well.

Hashes have 64 bits: among n windows, about n^2 / 2^65 pairs are equal by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .words import Words, slices

WIDTH = 35
# Text hashed at once; of a whole block only its texts and one number per window are held.
SLICE_BYTES = 512 << 10


def _repeats(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[bytes]:
    """A bit per key and block: whether another block has the key too."""
    whole = np.sort(np.concatenate(keys), kind="stable")
    twice = whole[1:][whole[1:] == whole[:-1]]
    twice = np.append(twice[np.append(True, twice[1:] != twice[:-1])] if len(twice) else twice, np.uint64(2**64 - 1))
    return [np.packbits(twice[np.minimum(np.searchsorted(twice, k), len(twice) - 1)] == k).tobytes() + len(k).to_bytes(4, "little") for k in keys]


def _bits(answers: list[bytes]) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(a[:-4], np.uint8), count=int.from_bytes(a[-4:], "little")) for a in answers]
    return np.concatenate(parts).astype(bool) if parts else np.empty(0, bool)


def covered(words: Words, starts: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in the windows that begin at `starts`."""
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _parts(column: pa.ChunkedArray) -> Iterator[list[str | None]]:
    """The texts of a block, SLICE_BYTES at a time."""
    for chunk in column.chunks:
        for a, b in slices(chunk, SLICE_BYTES):
            yield chunk.slice(a, b - a).to_pylist()


def _keys(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The hash of every window of a block, sorted."""
    parts = [Words(texts).windows(width)[0] for texts in _parts(column)]
    keys = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    parts.clear()
    keys.sort()
    return keys


def _first(keys: np.ndarray) -> np.ndarray:
    """Where a key of a sorted array comes for the first time."""
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    return first


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, keep_text: bool = True, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of `df`: key, n_words, n_removed, intervals, kept_sha256 and, if asked for, kept; and `carry` as a struct `carried`.

    `intervals` are the removed runs as (first word, words), maximal and in
    order; `kept` is the words that stay, joined by one space (null for a null
    text; with `carry`, a text that loses nothing stays as it is). Texts with fewer words than a window keep them all; a null text has
    no words. Repeated rows, also with the same key, count as texts of their own,
    so a text that occurs twice loses all that its windows cover.
    """
    partitions, n_blocks, parts = blocks.sizes(df, text)
    docs = blocks.dealt(df, key, text, partitions, n_blocks, carry)

    def send(batches: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what the last group left
        keys = _keys(batches.column("text"), width)
        return pa.Table.from_batches([blocks.packed(batches.column("block")[0].as_py(), keys[_first(keys)], None, parts)])

    sent = docs.groupBy("block").applyInArrow(send, blocks.KEYS)
    answers = blocks.answer(sent, 0, _repeats)
    kind = "long" if dict(df.dtypes)[key] == "bigint" else dict(df.dtypes)[key]
    schema = f"key {kind}, n_words long, n_removed long, intervals array<struct<first: int, words: int>>, kept_sha256 string, kept string"
    carried = f", carried {dict(docs.dtypes)['carried']}" if carry else ""

    def repeated(column: pa.ChunkedArray, replies: pa.Table) -> np.ndarray:
        """The keys of the block that come again, here or elsewhere, sorted."""
        keys = _keys(column, width)
        first = _first(keys)
        again = np.zeros(len(keys), bool)  # of a key's first place, whether a second one follows
        again[:-1] = ~first[1:]
        keys, again = keys[first], again[first]
        elsewhere = _bits(blocks.answers_of(replies, 0))
        if len(keys) != len(elsewhere):
            raise ValueError(f"{len(keys)} windows, {len(elsewhere)} answers")
        return keys[elsewhere | again]

    def cut(rows: pa.Table, replies: pa.Table) -> pa.Table:
        twice = repeated(rows.column("text"), replies)
        pa.default_memory_pool().release_unused()
        done = [cut_slice(texts, twice) for texts in _parts(rows.column("text"))]
        columns = pa.concat_tables(done) if done else cut_slice([], twice)
        return pa.table({"key": rows.column("key")} | {c: columns.column(c) for c in columns.column_names} | ({"carried": rows.column("carried")} if carry else {}))

    def cut_slice(texts: list[str | None], twice: np.ndarray) -> pa.Table:
        words = Words(texts)
        hashes, at = words.windows(width)
        found = np.searchsorted(twice, hashes)
        gone = covered(words, at[twice[np.minimum(found, len(twice) - 1)] == hashes] if len(twice) else at[:0], width)
        out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "intervals", "kept_sha256", "kept")}
        for i, t in enumerate(texts):
            mask = gone[words.offsets[i]:words.offsets[i + 1]]
            tokens = (t or "").encode("utf-8", "surrogatepass").split()
            lost = int(mask.sum())
            kept = b" ".join(compress(tokens, (~mask).tolist()) if lost else tokens)
            edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))) if lost else np.empty(0, int)
            out["n_words"].append(len(tokens))
            out["n_removed"].append(lost)
            out["intervals"].append([{"first": int(a), "words": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(None if not keep_text or t is None else kept.decode("utf-8", "surrogatepass") if lost or not carry else t)
        kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "intervals": pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])),
                 "kept_sha256": pa.string(), "kept": pa.string()}
        return pa.table({c: pa.array(out[c], kind) for c, kind in kinds.items()})

    result = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, schema + carried)
    result = result if keep_text else result.drop("kept")
    return result.withColumnRenamed("key", key)


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of `df` with the repeated passages cut from the text; a text that loses nothing stays as it is."""
    rows = remove_repeats(df, key, text, width, carry=tuple(df.columns))
    return rows.select(*[(F.col("kept") if c == text else F.col("carried")[c]).alias(c) for c in df.columns])
