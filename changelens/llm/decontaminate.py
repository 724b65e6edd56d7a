"""Benchmark decontamination by an FM-index for each shard of the documents.

Both sides are read as words (fmindex works on their numbers).  A window is
WINDOW consecutive words of an item; an item of fewer words, but not none, is
one window.  Each task indexes its documents shard by shard: words that no item
has become separators, and a run of item words shorter than every window holds
none, so the index covers the other runs of the shard only, which loses no
window.  All windows are searched backwards at once; occurrences are located by
sampled positions and their words marked, which merges the spans.

Items come in blocks of at most BLOCK_BYTES of text.  Each block is sent, its
occurrences in all texts are written (a row for each text that has one), and it
is given back before the next one is read, so neither the driver nor a task
holds more than one block at any size of the benchmark.  Spans and items of one
text are merged over the blocks and joined with the documents by a 128-bit
fingerprint of the text.

Null and empty text has no words, and an item with a null or no text has no
windows.  Items of equal id count once; null item ids are left out of the
digest, and their windows still mark words.  Rows of equal or null id are each
judged by their own text.  The longest text sets the largest shard.  An empty
table of items marks nothing, and an empty table of documents gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textkernel as tk
from .fmindex import Index

WINDOW = 10
#: Text of the items that a task holds at once, and of the documents in a shard.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 2 << 20


class Phrases:
    """The windows of a block of items, as numbers of words from 1."""

    def __init__(self, item_ids: list, texts: list, size: int = WINDOW):
        hashes, _, _, counts = tk.words(*tk.buffers(pa.array(texts, pa.string())), tk.ALNUM)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        numbers = numbers.astype(np.int64) + 1
        have = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        first = np.cumsum(counts) - counts
        at = tk.gather(first, have)
        length = np.repeat(np.minimum(counts, size), have)
        grid = np.zeros((len(at), size), np.int64)
        for j in range(size):
            inside = length > j
            grid[inside, j] = numbers[at[inside] + j]
        self.patterns, back = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.zeros(0, np.int64))
        self.lengths = (self.patterns > 0).sum(1)
        self.shortest = int(self.lengths.min(initial=size))
        # items of each pattern
        own = np.unique(np.stack([back.reshape(-1), np.repeat(np.arange(len(counts)), have)], 1), axis=0) if len(grid) else np.zeros((0, 2), np.int64)
        self.item_of, self.item_at = own[:, 1], np.searchsorted(own[:, 0], np.arange(len(self.patterns) + 1))
        self.item_ids = item_ids

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for one that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        # a table over 16 bits of the fingerprint rules out most other words before the search
        if not hasattr(self, "filter"):
            self.filter = np.zeros(1 << 20, bool)
            self.filter[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out

    def occurrences(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pattern and first word of each occurrence in the texts of a shard."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(hashes) or not len(self.patterns):
            return none
        numbers = self.numbers(hashes)
        # a run ends where a word is no item's, or a text ends
        ends = np.cumsum(counts)
        edge = np.zeros(len(hashes) + 1, bool)
        edge[ends] = edge[0] = True
        known = numbers > 0
        start = known & (edge[:-1] | np.append(True, ~known[:-1]))
        stop = known & (edge[1:] | np.append(~known[1:], True))
        a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
        long = b - a >= self.shortest
        a, size = a[long], (b - a)[long]
        if not len(a):
            return none
        # the runs with a separator after each; from: the word of each place
        words = tk.gather(a, size)
        symbols = np.zeros(len(words) + len(a), np.int64)
        place = np.arange(len(words)) + np.repeat(np.arange(len(a)), size)
        symbols[place] = numbers[words]
        from_ = np.zeros(len(symbols), np.int64)
        from_[place] = words
        # numbers that occur, without gaps: the wavelet matrix has as many levels as they need
        used, symbols = np.unique(symbols, return_inverse=True)
        index = Index(symbols.reshape(-1))
        at = np.searchsorted(used, self.patterns)
        at = np.where(used[np.minimum(at, len(used) - 1)] == self.patterns, at, len(used))
        low, high = index.search(at, self.lengths)
        n = high - low
        return np.repeat(np.arange(len(n)), n), from_[index.locate(tk.gather(low, n))]

    def hits(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words lie in an occurrence; and pairs of a text and an item that has a window there."""
        pattern, first = self.occurrences(hashes, counts)
        turn = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(turn, first, 1)
        np.add.at(turn, first + self.lengths[pattern], -1)
        text = np.searchsorted(np.cumsum(counts), first, "right")
        n = self.item_at[pattern + 1] - self.item_at[pattern]
        pairs = np.stack([np.repeat(text, n), self.item_of[tk.gather(self.item_at[pattern], n)]], 1)
        pairs = np.unique(pairs, axis=0)
        return np.cumsum(turn[:-1]) > 0, pairs[:, 0], pairs[:, 1]


def blocks(items: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[Phrases]:
    """The items, a bounded block at a time."""
    ids, texts, held = [], [], 0
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).orderBy("id", "text")
    for row in rows.toLocalIterator():
        ids.append(row.id)
        texts.append(row.text)
        held += len(row.text)
        if held >= BLOCK_BYTES:
            yield Phrases(ids, texts, size)
            ids, texts, held = [], [], 0
    if ids or not held:
        yield Phrases(ids, texts, size)


_SPANS = "array<struct<start: long, end: long>>"
_HITS = f"t1 long, t2 long, spans {_SPANS}, items array<string>"


def _search(sent):
    """A row for each text that has a window of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            for a, b, data, offsets in tk.pieces(*tk.buffers(batch.column(2)), SHARD_BYTES):
                hashes, _, _, counts = tk.words(data, offsets, tk.ALNUM)
                hit, text, item = block.hits(hashes, counts)
                found: dict[int, set] = {}
                for t, i in zip(text.tolist(), item.tolist(), strict=True):
                    own = found.setdefault(t, set())
                    if block.item_ids[i] is not None:
                        own.add(block.item_ids[i])
                ends, spans = np.cumsum(counts), []
                at = sorted(found)
                for t in at:
                    own = np.concatenate([[False], hit[ends[t] - counts[t] : ends[t]], [False]])
                    turns = np.flatnonzero(own[1:] != own[:-1]).tolist()
                    spans.append([{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2], strict=True)])
                if at:
                    rows = pa.array([a + t for t in at], pa.int64())
                    yield pa.RecordBatch.from_pydict({"t1": batch.column(0).take(rows), "t2": batch.column(1).take(rows), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "items": pa.array([sorted(found[t]) for t in at], pa.list_(pa.string()))})

    return run


def _prints(text_col: str) -> list:
    text = F.col(text_col)
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, scratch: store.Scratch | None = None) -> DataFrame:
    """(t1, t2, spans, items) of every distinct text that has a window: t1 and t2 fingerprint the text, spans are merged, in words, in order."""
    scratch = scratch or store.Scratch()
    t1, t2 = _prints(text_col)
    texts = docs.select(t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text")).where("text is not null")
    every = None
    for block in blocks(items, item_id, item_text, size):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        part = scratch.written(texts.mapInArrow(_search(sent), _HITS).dropDuplicates(["t1", "t2"]), "hits")
        sent.destroy()
        every = part if every is None else every.union(part)
    # spans of several blocks overlap: each goes on to the farthest end so far
    flat = F.array_sort(F.flatten(F.collect_list("spans")))
    grown = lambda have, x: F.when((F.size(have) > 0) & (F.element_at(have, -1)["end"] >= x["start"]), F.concat(F.slice(have, 1, F.size(have) - 1), F.array(F.struct(F.element_at(have, -1)["start"].alias("start"), F.greatest(F.element_at(have, -1)["end"], x["end"]).alias("end"))))).otherwise(F.array_append(have, x))
    sets = every.groupBy("t1", "t2").agg(flat.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count("*").alias("n"))
    merged = F.when(F.col("n") == 1, F.col("spans")).otherwise(F.aggregate("spans", F.expr(f"cast(array() as {_SPANS})"), grown))
    return scratch.written(sets.select("t1", "t2", merged.alias("spans"), "items"), "found")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in tk.pieces(*tk.buffers(batch.column(3)), SHARD_BYTES):
            own = batch.slice(a, b - a)
            yield pa.RecordBatch.from_pydict({"doc_id": own.column(0), "t1": own.column(1), "t2": own.column(2), "n_words": pa.array(tk.spans(data, offsets, tk.ALNUM)[2])})


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit spans in words."""
    scratch = store.Scratch()
    found = hits(docs, items, text_col, item_id, item_text, size, scratch)
    t1, t2 = _prints(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text")).mapInArrow(_counted, "doc_id long, t1 long, t2 long, n_words long")
    spans, own = F.coalesce("spans", F.expr(f"cast(array() as {_SPANS})")), F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = rows.join(found, ["t1", "t2"], "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(own).cast("long").alias("n_items"), F.sha2(F.array_join(own, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), spans.alias("spans"))
    return scratch.finish(out, "report")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """docs with the hit words, and what stands between words of one span, cut out of the texts; null stays null.

    Texts that a sieve of the hit ones does not find stay where they are.
    Columns of docs may have any names.
    """
    found = hits(docs, items, text_col, item_id, item_text, size)
    names = store.fresh(docs.columns, "t1", "t2", "spans", "maybe")
    t1, t2, spans, maybe = names
    some = found.select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("spans").alias(spans))
    words = store.written(store.sieve(some.select(t1, t2)), "sieve")
    a, b = _prints(text_col)
    rows = store.sifted(docs.withColumn(t1, a).withColumn(t2, b), words, F.col(t1), F.col(t2), name=maybe)
    doubtful = rows.where(F.col(maybe)).join(some, [t1, t2], "left").select(*docs.columns, spans)
    own_names, schema = list(docs.columns), docs.schema
    place = own_names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(place), []
            for row, own in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                text = texts[row].as_py()
                if own:
                    data, offsets = tk.buffers(texts.slice(row, 1))
                    starts, ends, _ = tk.spans(data, offsets, tk.ALNUM)
                    at, parts = 0, []
                    for s in own:
                        parts.append(data[at : int(starts[s["start"]])].tobytes())
                        at = int(ends[s["end"] - 1])
                    text = b"".join([*parts, data[at:].tobytes()]).decode()
                out.append(text)
            columns = [pa.array(out, texts.type) if i == place else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=own_names)

    return rows.where(~F.col(maybe)).select(*docs.columns).unionByName(doubtful.mapInArrow(cut, schema))
