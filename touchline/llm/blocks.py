"""Questions about hashes, answered by shards without moving text twice.

Rows are dealt into blocks of a few megabytes of text. A block sends every hash it holds once, packed as sorted gaps, to the
shards of the hash space; a shard compares the blocks' lists and answers each block in the order of its list. A hot hash costs
one entry per block, however many rows hold it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 22
SHARD_BYTES = 9 << 20  # of text, about a million and a half words
QUESTION = "block int, shard int, keys binary, extra binary"
ANSWER = "block int, shard int, reply binary"
_U = np.uint64


def octets(docs: DataFrame, text: str) -> int:
    """Bytes of all text of ``docs``."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def sizes(docs: DataFrame, text: str, total: int | None = None) -> tuple[int, int]:
    """Numbers of blocks and of shards (a power of two) for all text of ``docs``, whose bytes may be known."""
    total = octets(docs, text) if total is None else total
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // BLOCK_BYTES)), 1 << (max(least, -(-total // SHARD_BYTES)) - 1).bit_length()


def pack(values: np.ndarray, base: int) -> bytes:
    """Sorted 64-bit values from ``base`` on as gaps of as few bytes as most of them need, and the others' upper bytes."""
    gaps = np.diff(values - _U(base), prepend=_U(0))
    mean = float(gaps.mean()) if len(gaps) else 0.0
    width = min(8, max(1, -(-(int(mean).bit_length() + 2) // 8)))
    high = gaps >> _U(8 * width) if width < 8 else np.zeros(len(gaps), _U)
    odd = np.flatnonzero(high)
    low = np.ascontiguousarray(gaps).view(np.uint8).reshape(-1, 8)[:, :width]
    return struct.pack("<IIB", len(gaps), len(odd), width) + odd.astype("<u4").tobytes() + high[odd].astype("<u8").tobytes() + low.tobytes()


def unpack(blob: bytes, base: int) -> np.ndarray:
    n, odd, width = struct.unpack_from("<IIB", blob)
    at = 9
    where = np.frombuffer(blob, "<u4", odd, at)
    high = np.frombuffer(blob, "<u8", odd, at + 4 * odd)
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8, n * width, at + 12 * odd).reshape(n, width)
    gaps = raw.reshape(-1).view("<u8").copy()
    if odd:
        gaps[where] |= high << _U(8 * width)
    return np.cumsum(gaps, dtype=_U) + _U(base)


def cuts(values: np.ndarray, shards: int) -> tuple[np.ndarray, int]:
    """Where each shard's part of the sorted values begins (one more at the end), and the shift from value to shard."""
    shift = 64 - (shards.bit_length() - 1)
    edges = np.arange(1, shards, dtype=_U) << _U(shift) if shards > 1 else np.empty(0, _U)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]]), shift


def questions(block: int, values: np.ndarray, shards: int, extra: Callable[[int, int], bytes] = lambda lo, hi: b"") -> pa.Table:
    """One row for each shard that holds any of the sorted, distinct values."""
    at, shift = cuts(values, shards)
    used = np.flatnonzero(np.diff(at))
    rows = [(s, pack(values[at[s] : at[s + 1]], s << shift if shards > 1 else 0), extra(at[s], at[s + 1])) for s in used.tolist()]
    return pa.table({
        "block": pa.array([block] * len(rows), pa.int32()), "shard": pa.array([r[0] for r in rows], pa.int32()),
        "keys": pa.array([r[1] for r in rows], pa.binary()), "extra": pa.array([r[2] for r in rows], pa.binary())})


def asked(table: pa.Table, shards: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(block, values, extra) of a shard's rows, by block."""
    shift = 64 - (shards.bit_length() - 1)
    for row in table.sort_by("block").to_pylist():
        yield row["block"], unpack(row["keys"], row["shard"] << shift if shards > 1 else 0), row["extra"]


def answers(shard: int, replies: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"block": pa.array([b for b, _ in replies], pa.int32()), "shard": pa.array([shard] * len(replies), pa.int32()),
                     "reply": pa.array([r for _, r in replies], pa.binary())})


def replies(table: pa.Table) -> list[bytes]:
    """A block's replies in the order of its values."""
    return table.sort_by("shard").column("reply").to_pylist()
