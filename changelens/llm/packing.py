"""Packing token ids into sequences by Karmarkar-Karp multiway differencing.

Each task packs the documents of its own part of the input, in order, a bin
set at a time: full pieces of CAPACITY ids are sequences of their own; what is
left of each document is cut into pieces of at most MOST ids, and the pieces
are differenced into WINDOWS near-equal windows.  The document that would
overfill a bin set is cut, and goes on in the next.  Should a window still get
more than the capacity, the set is differenced anew into one window more.

Differencing: every piece starts as a partial partition with one filled window.
The two partial partitions with the largest imbalance (fullest less emptiest
window) are merged, the fullest windows of one with the emptiest of the other,
until one is left.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .tokens import PIECE_BYTES, Encoder, with_end

CAPACITY = 1024
#: The longest piece that differencing gets; the windows of a bin set; the room left in each for uneven sums.
MOST, WINDOWS, SLACK = 256, 32, 4

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """The numbers of the items in each of k near-equal windows."""
    if k == 1 or not sizes:
        return [list(range(len(sizes))), *[[] for _ in range(k - 1)]]
    # a partial partition: window sums, ascending and less the least, and the items of each as a nested tuple
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = size
        heap.append((-size, i, sums, [None] * (k - 1) + [i]))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(sums, kind="stable")
        y = y[::-1]
        both = [p if q is None else q if p is None else (p, q) for p, q in zip(x, y, strict=True)]
        sums = sums[order]
        sums -= sums[0]
        made += 1
        heapq.heappush(heap, (-int(sums[-1]), made, sums, [both[i] for i in order.tolist()]))
    out = []
    for tree in heap[0][3]:
        found, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack += t
            elif t is not None:
                found.append(t)
        out.append(sorted(found))
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """difference() into as few windows as hold the items; one more whenever a window gets more than the capacity."""
    if any(s > capacity for s in sizes):
        raise ValueError("an item is larger than a window")
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        k += 1


def cut(length: int, most: int) -> list[int]:
    """Near-equal parts of at most `most`."""
    parts = -(-length // most)
    return [length // parts + (i < length % parts) for i in range(parts)]


class Packer:
    """Takes documents one by one; each call returns the pieces that are placed: document, start, length, sequence, offset."""

    def __init__(self, capacity: int = CAPACITY, most: int = MOST, count: int = WINDOWS, slack: int = SLACK):
        self.capacity, self.most, self.room = capacity, min(most, capacity), count * (capacity - slack)
        self.sequence, self.held, self.sum = 0, [], 0

    def add(self, doc: int, length: int) -> list[tuple[int, int, int, int, int]]:
        out, at = [], 0
        while length - at >= self.capacity:
            out.append((doc, at, self.capacity, self.sequence, 0))
            self.sequence, at = self.sequence + 1, at + self.capacity
        while at < length:
            part = min(length - at, self.room - self.sum)
            self.held.append((doc, at, part))
            self.sum, at = self.sum + part, at + part
            if self.sum == self.room:
                out += self.flush()
        return out

    def flush(self) -> list[tuple[int, int, int, int, int]]:
        pieces = []
        for doc, at, length in self.held:
            for size in cut(length, self.most):
                pieces.append((doc, at, size))
                at += size
        if pieces:  # a last piece in parts of 1, 2, 4, ... lets the differences close
            doc, at, size = pieces.pop()
            step = 1
            while size:
                step = min(step, size)
                pieces.append((doc, at, step))
                at, size, step = at + step, size - step, 2 * step
        out = []
        for window in windows([p[2] for p in pieces], self.capacity):
            offset, last = 0, None
            for i in window:
                doc, at, size = pieces[i]
                if last and last[0] == doc and last[1] + last[2] == at:  # goes on where the last one ends
                    last[2] += size
                else:
                    last = [doc, at, size, self.sequence, offset]
                    out.append(last)
                offset += size
            self.sequence += 1
        self.held, self.sum = [], 0
        return [tuple(p) for p in out]


def pack(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids themselves.

    Every id lies in exactly one piece, and each document ends with the end id.
    A null text counts as empty, and so has the end id alone; null and repeated
    document ids stay, as rows of their own.  Sequence ids are distinct over all
    tasks, with gaps.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, base = Encoder.at(tokenizer), Packer(capacity), TaskContext.get().partitionId() << 32
        # ids of the documents that have pieces still to place: number -> (document, ids)
        kept: dict[int, tuple] = {}
        number = 0

        def rows(placed: list) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(8)]
            for n, start, length, sequence, offset in placed:
                doc, ids = kept[n]
                own = ids[start : start + length]
                for column, value in zip(out, (doc, start, length, zlib.crc32(own), len(ids), base + sequence, offset, own if with_ids else None), strict=True):
                    column.append(value)
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            table = {name: pa.array(column, pa.int64()) for name, column in zip(names, out, strict=False)}
            if with_ids:
                table["ids"] = pa.array([x.astype(np.int64) for x in out[7]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_pydict(table)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            data, offsets = tk.buffers(batch.column(1))
            for a, b, piece, own in tk.pieces(data, offsets, PIECE_BYTES):
                ids, counts = with_end(*encoder.encode(piece, own), end)
                ids, ends = ids.astype("<u4"), np.cumsum(counts)
                placed = []
                for i in range(a, b):
                    kept[number] = (doc_ids[i], ids[ends[i - a] - counts[i - a] : ends[i - a]])
                    placed += packer.add(number, int(counts[i - a]))
                    number += 1
                if placed:
                    yield rows(placed)
                waiting = {h[0] for h in packer.held}
                kept = {n: (d, x.copy()) for n, (d, x) in kept.items() if n in waiting}
        if placed := packer.flush():
            yield rows(placed)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA + ", ids array<long>" * with_ids)
