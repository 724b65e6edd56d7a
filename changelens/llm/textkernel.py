"""Vectorised kernels over Arrow string buffers.

Texts are read straight from the Arrow buffers as UTF-8 bytes, in pieces of a
bounded number of bytes (one document is never split, so the largest document
sets the least memory).  Words are maximal runs of bytes that a 256-entry table
marks; A-Z count as a-z.  Every word gets a 64-bit polynomial fingerprint.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19

_U = np.uint64
_R, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: `[^\x20\x09-\x0D]+`
NON_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are lower-cased
ALNUM = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_CODE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER_CODE = _CODE[LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64, for i below n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_R, -1, 1 << 64)
        for k, r in enumerate((_R, inverse)):
            steps = np.full(size, r, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of an Arrow string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    width = np.int64 if wide else np.int32
    if where is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = PIECE_BYTES, rows: int = 60_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes: first row, row after the last, bytes, offsets."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n, first + rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    if len(data) > most:
        release()


def release() -> None:
    """Gives freed memory back, as Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = table[data]
    turn = np.empty(len(data) + 1, bool)
    turn[0], turn[-1] = word[0], False
    np.logical_and(word[1:], ~word[:-1], out=turn[1:-1])
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    turn[cuts] |= word[cuts]
    starts = np.flatnonzero(turn)
    turn[0], turn[-1] = False, word[-1]
    np.logical_and(word[:-1], ~word[1:], out=turn[1:-1])
    ends = offsets[1:][offsets[1:] > 0]
    turn[ends] |= word[ends - 1]
    return starts, np.flatnonzero(turn), np.diff(np.searchsorted(starts, offsets))


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit fingerprints of the byte runs, of their lower-cased form if asked for."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER_CODE if lower else _CODE)[data] * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, start and end of each lower-cased word, and words per text."""
    starts, ends, counts = spans(data, offsets, table)
    return fingerprints(data, starts, ends), starts, ends, counts


_ORDER = (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F, 0x91E10DA5C79E7B1D, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5, 0xF7C2EBC08F67F2B5)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of k words of each text, and how many each text has.

    A text of fewer words, but not none, has its whole sequence as one.
    """
    have = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    total = int(have.sum())
    if not total:
        return np.zeros(0, np.uint64), have
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(have) - have), have) + np.arange(total)
    left = np.repeat(np.minimum(counts, k), have)
    out = left.astype(np.uint64)
    for j in range(k):
        inside = left > j
        out = out + np.where(inside, hashes[np.minimum(at + j, len(hashes) - 1)] * _U(_ORDER[j % 8] + 2 * (j // 8)), _U(0))
    return mix(out), have


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the runs, run after run."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


def strings(values: list, kind=None) -> pa.Array:
    return pa.array(values, kind or pa.string())
