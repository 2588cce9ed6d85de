"""Words of whole Arrow text columns as numpy arrays: no loop over words, memory bound by the piece given."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 22
_HASH_BYTES = 1 << 20
_U = np.uint64
# Odd multipliers of the two rolling hashes (over bytes, over words), with their inverses modulo 2**64.
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BYTE_INVERSE, _WORD_INVERSE = pow(_BYTE, -1, 1 << 64), pow(_WORD, -1, 1 << 64)

#: Bytes that are neither a space nor a control character from tab to carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, letters and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_lo : _hi + 1] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes on end and the offsets of its rows; NULL is empty."""
    array = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array | pa.ChunkedArray, most: int = PIECE_BYTES):
    """Row ranges (from, to) of at most ``most`` bytes each; a longer row is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) if len(column) else np.empty(0)
    total = np.concatenate([[0], np.cumsum(sizes)])
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each row (one more at the end)."""
    inside = table[data]
    n = len(data)
    begins, stops = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        at = offsets[:-1][offsets[:-1] < n]
        begins[at] = inside[at]
        at = offsets[1:][offsets[1:] > 0] - 1
        stops[at] = inside[at]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all of them."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), _U)
    longest = int((ends - starts).max(initial=0))
    up = _powers(_BYTE, max(_HASH_BYTES, longest) + 1)
    down = _powers(_BYTE_INVERSE, max(_HASH_BYTES, longest) + 1)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + _HASH_BYTES, "right")))
        part = data[a : ends[j - 1]]
        total = np.zeros(len(part) + 1, _U)
        np.cumsum((part.astype(_U) + _U(1)) * up[: len(part)], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(_U)
        i = j
    return mix(out)


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (word numbers) of the windows of ``size`` words within one row, and their hashes."""
    n = len(hashes)
    if n < size:
        return np.empty(0, np.int64), np.empty(0, _U)
    total = np.zeros(n + 1, _U)
    np.cumsum(hashes * _powers(_WORD, n), out=total[1:])
    last = np.repeat(first[1:], np.diff(first))  # one past the row's last word
    at = np.flatnonzero(np.arange(size, n + 1) <= last[: n - size + 1])
    return at, mix((total[at + size] - total[at]) * _powers(_WORD_INVERSE, n)[at] + _U(size))
