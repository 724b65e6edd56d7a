"""Simple-8b word-aligned integer coding, and the shard image that holds token ids.

A 64-bit word has a selector in its top 4 bits and 60 bits of payload.
Selectors 1 to 14 pack COUNTS[s] ids of WIDTHS[s] bits, the first id lowest.
Selector 15 is the escape: the next word is one id of more than 60 bits, as is.
Ids are coded in blocks of BLOCK; each starts a new word, and a table has the
first word of each block, so that blocks decode alone and words of one selector
decode together.  The last word of a block may hold fewer ids than it could.

Shard image, little-endian: magic "S8TK", version u32, documents u64, ids u64,
blocks u64, words u64; then per document its id i64 (0 where null), its null
flag u8 and its ids u32; per block its first word u64; then the words u64.
"""

from __future__ import annotations

import struct

import numpy as np

COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
BLOCK = 4096
_U = np.uint64
_HEAD = struct.Struct("<4sIQQQQ")


#: the least width that holds each value below 2**16
_NEED = np.array([next(w for w in WIDTHS[1:] if v < 1 << w) for v in range(1 << 16)], np.uint8)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """The width of the narrowest field that holds each id; 64 where none does."""
    out = _NEED[(ids & _U(0xFFFF)).astype(np.uint16)]
    for w, low in ((20, 16), (30, 20), (60, 30), (64, 60)):
        if not (wide := ids >= _U(1 << low)).any():
            break
        out[wide] = w
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block."""
    ids = np.asarray(ids, _U)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, _U), np.zeros(0, _U)
    grid = np.zeros((blocks, BLOCK + 60), _U)
    pad = np.zeros(blocks * BLOCK, _U)
    pad[:n] = ids
    grid[:, :BLOCK] = pad.reshape(blocks, BLOCK)
    bits = bit_lengths(grid)
    bits[:, BLOCK:] = 0
    if n % BLOCK:
        bits[-1, n % BLOCK :] = 0
    # most[c]: the widest of c ids from here on
    most = {1: bits}

    def widen(c: int, a: int, b: int) -> None:
        most[c] = np.zeros_like(bits)
        most[c][:, : -a or None] = np.maximum(most[a][:, : -a or None], most[b][:, a:])

    for c, a, b in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 7), (20, 12, 8), (30, 20, 10), (60, 30, 30)):
        widen(c, a, b)
    pick = np.full(bits.shape, ESCAPE, np.uint8)
    for s in range(14, 0, -1):
        np.copyto(pick, np.uint8(s), where=most[COUNTS[s]] <= WIDTHS[s])
    step = np.array([*COUNTS, 1], np.int64)
    length = np.full(blocks, BLOCK, np.int64)
    length[-1] = n - (blocks - 1) * BLOCK
    # all blocks walk from word to word at once; at: place in the flattened grid
    wide = grid.shape[1]
    flat, kinds, starts = grid.reshape(-1), pick.reshape(-1), np.zeros(grid.size, bool)
    at = np.arange(blocks) * wide
    stop = at + length
    while len(at):
        starts[at] = True
        at = at + step[kinds[at]]
        on = at < stop
        if not on.all():
            at, stop = at[on], stop[on]
    at = np.flatnonzero(starts)
    s = kinds[at]
    place = np.arange(len(s)) + np.concatenate([[0], np.cumsum(s == ESCAPE)[:-1]])
    words = np.zeros(len(s) + int((s == ESCAPE).sum()), _U)
    for k in range(1, 15):
        own = np.flatnonzero(s == k)
        if len(own):
            c, w, from_ = COUNTS[k], WIDTHS[k], at[own]
            word = np.full(len(own), k << 60, _U)
            for j in range(c):
                word |= flat[from_ + j] << _U(w * j)
            words[place[own]] = word
    own = np.flatnonzero(s == ESCAPE)
    words[place[own]] = _U(ESCAPE << 60)
    words[place[own] + 1] = flat[at[own]]
    return words, place[np.searchsorted(at, np.arange(blocks) * wide)].astype(_U)


def decode(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The n ids of all blocks."""
    out = np.zeros(n, _U)
    if not n:
        return out
    kind = (words >> _U(60)).astype(np.int64)
    # a raw word follows each escape; its own top bits say nothing
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(kind == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    count = np.where(raw, 0, np.array([*COUNTS, 1])[kind])
    # where the ids of each word go; a block starts at a multiple of BLOCK
    block = np.searchsorted(first.astype(np.int64), np.arange(len(words)), "right") - 1
    sums = np.cumsum(count) - count
    at = sums - sums[first.astype(np.int64)][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for k in range(1, 15):
        own = np.flatnonzero((kind == k) & ~raw)
        if len(own):
            c, w = COUNTS[k], WIDTHS[k]
            to = at[own][:, None] + np.arange(c)
            values = (words[own][:, None] >> (np.arange(c, dtype=_U) * _U(w))) & _U((1 << w) - 1)
            inside = to < end[own][:, None]
            out[to[inside]] = values[inside]
    own = np.flatnonzero((kind == ESCAPE) & ~raw)
    out[at[own]] = words[own + 1]
    return out


def image(doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, first = encode(ids)
    head = _HEAD.pack(b"S8TK", 1, len(doc_ids), len(ids), len(first), len(words))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), null.astype("u1").tobytes(), counts.astype("<u4").tobytes(), first.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def read_image(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, null flags, ids per document, and all ids."""
    magic, version, docs, n, blocks, size = _HEAD.unpack_from(raw)
    if magic != b"S8TK" or version != 1:
        raise ValueError("no shard image of token ids")
    at, parts = _HEAD.size, []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u8", blocks), ("<u8", size)):
        parts.append(np.frombuffer(raw, kind, count, at))
        at += parts[-1].nbytes
    return parts[0], parts[1].astype(bool), parts[2].astype(np.int64), decode(parts[4], parts[3], n)
