"""Counting the 64-bit keys of all documents with packed arrays.

Documents are dealt by hash into blocks. A block sends its distinct keys,
sorted, as one packed row per range of keys; a range's task counts them over all
blocks and answers each block in the order of its keys, so an answer needs no
keys. A frequent key is one entry per block, whatever number of rows holds it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = "block long, part int, keys binary, counts binary"
ANSWERS = "block long, kind int, part int, answer binary"


# Text of a block, which one task holds at a time with the keys of its windows or tokens: BLOCK_BYTES, and more only
# where there would be more than MANY of them, up to MOST_BYTES. A range of keys answers for RANGE_BYTES of text.
BLOCK_BYTES, MANY, MOST_BYTES, RANGE_BYTES = 4 << 20, 4096, 64 << 20, 16 << 20


def sizes(df: DataFrame, text: str) -> tuple[int, int, int]:
    """Shuffle partitions, blocks and ranges of keys: the last two follow from the bytes of text, whatever the partitions."""
    whole = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    block = min(max(BLOCK_BYTES, whole // MANY), max(BLOCK_BYTES, MOST_BYTES))
    ranges = max(1, -(-whole // RANGE_BYTES))
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-whole // block)), 1 << (ranges - 1).bit_length()


def dealt(df: DataFrame, key: str, text: str, partitions: int, blocks: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns block, key and text, dealt by block, and a struct of those to carry; every later step meets the documents in these partitions."""
    others = [c for c in carry if c != text]
    # The text itself is carried once.
    rest = [F.struct(*[F.col(c) if c in others else F.lit(None).cast("string").alias(c) for c in carry]).alias("carried")] if carry else []
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *rest)
    block = F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).cast("long")
    return rows.select(block.alias("block"), *rows.columns).repartition(partitions, "block")


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the gaps, of as many bytes as the largest gap needs."""
    gaps = np.diff(keys)
    wide = (int(gaps.max(initial=0)).bit_length() + 7) // 8
    return bytes([wide]) + keys[:1].tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    wide = raw[0]
    gaps = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, wide) if wide else np.empty((0, 0), np.uint8)
    out = np.zeros((len(gaps) + 1, 8), np.uint8)
    out[0] = np.frombuffer(raw[1:9], np.uint8)
    out[1:, :wide] = gaps
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def pack_numbers(x: np.ndarray) -> bytes:
    """Non-negative integers, byte by byte: the many zero bytes of small ones compress away."""
    wide = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def unpack_numbers(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :raw[0]] = planes.T
    return out.view("<u8").ravel()


def pack_planes(x: np.ndarray) -> bytes:
    """Fixed-width values, byte by byte, so that alike bytes stand together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unpack_planes(raw: bytes, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).view(kind).ravel()


def packed(block: int, keys: np.ndarray, counts: np.ndarray | None, parts: int, bits: int = 64) -> pa.RecordBatch:
    """One row per range for sorted distinct keys of `bits` bits; ranges without keys get none."""
    shift = np.uint64(bits - (parts - 1).bit_length()) if parts > 1 else None
    cuts = np.searchsorted(keys >> shift, np.arange(parts + 1, dtype=np.uint64)) if parts > 1 else np.array([0, len(keys)])
    used = [i for i in range(parts) if cuts[i] < cuts[i + 1]]
    return pa.RecordBatch.from_arrays([
        pa.array([block] * len(used), pa.int64()), pa.array(used, pa.int32()),
        pa.array([pack_keys(keys[cuts[i]:cuts[i + 1]]) for i in used], pa.binary()),
        pa.array([b"" if counts is None else counts[cuts[i]:cuts[i + 1]].astype("<u4").tobytes() for i in used], pa.binary()),
    ], names=["block", "part", "keys", "counts"])


def answer(sent: DataFrame, kind: int, reply: Callable[[list[np.ndarray], list[np.ndarray]], list[bytes]]) -> DataFrame:
    """For each range, `reply` gets the keys and counts of every block and gives an answer for each."""

    def run(table: pa.Table) -> pa.Table:
        keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
        counts = [np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]
        out = reply(keys, counts)
        return pa.table({
            "block": table.column("block"), "kind": pa.array([kind] * len(out), pa.int32()), "part": table.column("part"),
            "answer": pa.array(out, pa.binary()),
        })

    return sent.groupBy("part").applyInArrow(run, ANSWERS)


def answers_of(table: pa.Table, kind: int) -> list[bytes]:
    """A block's answers of one kind, in the order of its keys."""
    rows = [(p, a) for k, p, a in zip(*(table.column(c).to_pylist() for c in ("kind", "part", "answer")), strict=True) if k == kind]
    return [a for _, a in sorted(rows)]
