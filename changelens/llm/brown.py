"""Class-based bigram scoring with Brown clusters.

Texts become blocks of about BLOCK_BYTES: the distinct words of a block
(64-bit fingerprints), and its tokens as numbers of them, written once to the
shared folder.  From the training documents come, over the whole corpus, the
count of every word, and the bigram counts between the HEAD most frequent words,
the end of a text and all other words.  Exchange clustering moves each frequent
word to the class that raises the likelihood of the class bigrams most, round
after round.  Then every other word that occurs COMMON times or more is placed,
by the same objective, in the class that its own neighbours speak for: one pass
over the blocks gathers the classes before and after it, a row for each word and
class, and each word is placed by itself.  Rarer words, which have too few
neighbours to tell, are one class, the end is one.  The model is

    P(w | v) = MIX * P(class(w) | class(v)) * P(w | class(w)) + (1 - MIX) * base(w)

with class transitions smoothed by class frequencies; unseen words are one more
word of the class of the rare.  It sums to 1 over all words and that one.
Transitions between two placed words are taken from the margins of both.

The vocabulary is never sent to one place: each block asks for the counts and
classes of its distinct words by a join, and gets them back as one row.  What
goes to the driver has a bound: HEAD words, (HEAD + 2)**2 bigram counts, and the
transitions of classes.

Words are `[^\\x20\\x09-\\x0D]+` of text whose A-Z are lower-cased, then one end.
Null and empty texts have the end alone.  Rows of equal id are each a text; a
row of null id is a training text.  A text is never divided, so the longest one
sets the largest block.  Ties in frequency go to the least fingerprint, ties in
gain to the least class.  Without training texts all probabilities are base; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textkernel as tk

HEAD, CLASSES, ROUNDS = 2048, 48, 8
#: Occurrences from which a word beyond the head is placed in a class.
COMMON = 8
MIX, SMOOTH = 0.95, 20.0
BLOCK_BYTES = 8 << 20
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_BLOCK = "block long, ids array<long>, held binary, counts binary, words binary, train binary, tokens binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

    def block() -> pa.RecordBatch:
        nonlocal seq, held, size
        ids, out, hashes, counts = [x for h in held for x in h[0]], *(np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
        words, tokens = np.unique(hashes, return_inverse=True)
        train = np.bincount(tokens[np.repeat(~out, counts)], minlength=len(words))
        row = {"block": pa.array([(part << 32) + seq]), "ids": pa.array([ids], pa.list_(pa.int64()))}
        raw = {"held": out.astype("u1").tobytes(), "counts": counts.astype("<i8").tobytes(), "words": words.tobytes(), "train": train.astype("<i8").tobytes(), "tokens": tokens.astype("<u4").tobytes()}
        row |= {k: pa.array([v if k == "words" else zstandard.compress(v, 1)], pa.binary()) for k, v in raw.items()}
        seq, held, size = seq + 1, [], 0
        return pa.RecordBatch.from_pydict(row)

    for batch in batches:
        ids, out = batch.column(0).to_pylist(), np.asarray(batch.column(1)).astype(bool)
        for a, b, data, offsets in tk.pieces(*tk.buffers(batch.column(2))):
            hashes, _, _, counts = tk.words(data, offsets, tk.NON_SPACE)
            held.append((ids[a:b], out[a:b], hashes, counts))
            size += len(data) + (b - a)
            if size >= BLOCK_BYTES:
                yield block()
    if held:
        yield block()


def _open(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, train in zip(batch.column(0), batch.column(1), strict=True):
            h, n = np.frombuffer(words.as_py(), np.int64), _open(train.as_py(), "<i8")
            for i in range(0, len(h), 1 << 16):
                own = slice(i, i + (1 << 16))
                use = n[own] > 0
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[own][use]), "c": pa.array(n[own][use])})


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            h = np.frombuffer(words.as_py(), np.int64)
            for i in range(0, len(h), 1 << 16):
                part = h[i : i + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(part), block)), "pos": pa.array(np.arange(i, i + len(part)), pa.int32()), "h": pa.array(part)})


def _before(tokens: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with an end after each text, and what stands before each; an end before the first."""
    after = np.insert(tokens, np.cumsum(counts), end)
    return after, np.concatenate([[end], after[:-1]])


def _bigrams(head: np.ndarray):
    """Counts of bigrams of training texts, as 64-bit codes over the head words, the end and the rest."""
    order = np.argsort(head)
    known, n = head[order], len(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, held, counts, tokens in zip(*(batch.column(i) for i in range(4)), strict=True):
                words = np.frombuffer(words.as_py(), np.int64)
                at = np.minimum(np.searchsorted(known, words), max(n - 1, 0))
                number = np.where(known[at] == words, order[at], n + 1) if n else np.full(len(words), n + 1)
                use, counts = _open(held.as_py(), "u1") == 0, _open(counts.as_py(), "<i8")
                own = number[_open(tokens.as_py(), "<u4")][np.repeat(use, counts)]
                after, before = _before(own, counts[use], n)
                code, c = np.unique(before * (n + 2) + after, return_counts=True)
                yield pa.RecordBatch.from_pydict({"code": pa.array(code.astype(np.int64)), "c": pa.array(c.astype(np.int64))})

    return run


def _neighbours(head: np.ndarray, own: np.ndarray, classes: int):
    """Of words beyond the head in training texts: how often each class stands before (its number) and after it (and classes + 2 more)."""
    order = np.argsort(head)
    known, n = head[order], len(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, held, counts, tokens in zip(*(batch.column(i) for i in range(4)), strict=True):
                words = np.frombuffer(words.as_py(), np.int64)
                at = np.minimum(np.searchsorted(known, words), max(n - 1, 0))
                inside = known[at] == words if n else np.zeros(len(words), bool)
                kind = np.append(np.where(inside, own[order[at]], classes + 1) if n else np.full(len(words), classes + 1), classes)
                use, counts = _open(held.as_py(), "u1") == 0, _open(counts.as_py(), "<i8")
                tokens = _open(tokens.as_py(), "<u4")[np.repeat(use, counts)].astype(np.int64)
                after, before = _before(tokens, counts[use], len(words))
                size = 2 * classes + 4
                out = [np.zeros(0, np.int64)]
                for word, other, shift in ((after, kind[before], 0), (before, kind[after], classes + 2)):
                    rare = np.flatnonzero(kind[word] == classes + 1)
                    out.append(word[rare] * size + other[rare] + shift)
                code, c = np.unique(np.concatenate(out), return_counts=True)
                for i in range(0, len(code), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_pydict({"h": pa.array(words[code[part] // size]), "code": pa.array((code[part] % size).astype(np.int16)), "n": pa.array(c[part].astype(np.int64))})

    return run


def place(after: np.ndarray, before: np.ndarray, total: np.ndarray, mass: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word, by its counts of classes after and before it: the exchange objective, with all else as it is."""
    weight, best = before.sum(1), np.zeros(len(after), np.int64)
    high = np.full(len(after), -np.inf)
    for b in range(classes):
        gain = (_xlogx(total[b] + after) - _xlogx(total[b])).sum(1) + (_xlogx(total[:, b] + before) - _xlogx(total[:, b])).sum(1) - 2 * (_xlogx(mass[b] + weight) - _xlogx(mass[b]))
        better = gain > high + 1e-9
        best[better], high[better] = b, gain[better]
    return best


def _placed(total: np.ndarray, mass: np.ndarray, classes: int, common: int):
    """(h, class, code, n) of rows (h, code, n) sorted by h: words that occur often enough, with the counts of their neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[np.ndarray] | None = None

        def done(h: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            words, row = np.unique(h, return_inverse=True)
            counts = np.zeros((len(words), 2 * classes + 4))
            counts[row, code] = n
            own = np.flatnonzero(counts[:, : classes + 2].sum(1) >= common)
            found = np.full(len(words), -1)
            for i in range(0, len(own), 1024):
                k = own[i : i + 1024]
                found[k] = place(counts[k, classes + 2 :], counts[k, : classes + 2], total, mass, classes)
            use = found[row] >= 0
            return pa.RecordBatch.from_pydict({"h": pa.array(h[use]), "class": pa.array(found[row][use], pa.int32()), "code": pa.array(code[use], pa.int32()), "n": pa.array(n[use])})

        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(rows[0]):
                continue
            if tail:
                rows = [np.concatenate(x) for x in zip(tail, rows, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield done(*(x[:last] for x in rows))
            tail = [x[last:] for x in rows]
        if tail:
            yield done(*tail)

    return run


def spread(total: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Class transitions once words leave the class of the rare (the last): after and before are the counts of those placed in each class."""
    rare = len(total) - 1
    out = total.copy()
    both = max(total[rare, rare], 1e-9)
    # what follows and comes before placed words is known but for rare ones, which are split by the margins
    out[:rare, :rare] += before[:rare, :rare] + after[:rare, :rare] + np.outer(after[:rare, rare], before[rare, :rare]) / both
    left, right = both - after[:rare, rare].sum(), both - before[rare, :rare].sum()
    out[:rare, rare] = total[:rare, rare] - before[:rare, :rare].sum(1) + after[:rare, rare] * right / both
    out[rare, :rare] = total[rare, :rare] - after[:rare, :rare].sum(0) + before[rare, :rare] * left / both
    out[rare, rare] = left * right / both
    return np.maximum(out, 0)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each word by exchange clustering; pairs: bigram counts of words, most frequent first, then the end and the rest.

    The last two keep classes of their own, `classes` and `classes + 1`.
    """
    n = len(pairs) - 2
    if n <= 0:
        return np.array([classes, classes + 1])
    own = np.concatenate([np.arange(n) % classes, [classes, classes + 1]])
    size = classes + 2
    one = np.zeros((n + 2, size))
    one[np.arange(n + 2), own] = 1
    right, left = pairs @ one, pairs.T @ one  # of each word: counts of classes after and before it
    total = one.T @ right
    weight = pairs.sum(1)
    mass = one.T @ weight
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            a, twice = own[w], pairs[w, w]
            r, f = right[w].copy(), left[w].copy()
            # without w: its own bigrams leave with it
            total[a] -= r
            total[:, a] -= f
            total[a, a] += twice
            mass[a] -= weight[w]
            r[a] -= twice
            f[a] -= twice
            rows, cols = total[:classes], total[:, :classes].T
            gain = (_xlogx(rows + r) - _xlogx(rows)).sum(1) + (_xlogx(cols + f) - _xlogx(cols)).sum(1)
            b = np.arange(classes)
            corner = total[b, b]
            gain += _xlogx(corner + r[b] + f[b] + twice) - _xlogx(corner + r[b]) - _xlogx(corner + f[b]) + _xlogx(corner)
            gain -= 2 * (_xlogx(mass[:classes] + weight[w]) - _xlogx(mass[:classes]))
            best = int(np.argmax(gain))
            if gain[best] <= gain[a] + 1e-9:
                best = a
            total[best] += r
            total[:, best] += f
            total[best, best] += twice
            mass[best] += weight[w]
            if best != a:
                moved += 1
                own[w] = best
                right[:, a] -= pairs[:, w]
                right[:, best] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, best] += pairs[w]
        if moved <= n // 200:
            break
    return own


class Model:
    """Probabilities from the counts of words, class transitions, and the classes.

    rest_words: distinct words of the class of the rare, besides the unseen one.
    """

    def __init__(self, head: np.ndarray, own: np.ndarray, total: np.ndarray, tokens: int, distinct: int, ends: int, rest_words: int, classes: int = CLASSES):
        order = np.argsort(head)
        self.known, self.order, self.own = head[order], order, own
        self.tokens, self.distinct, self.ends, self.classes = tokens, distinct, ends, classes
        share = (total.sum(0) + 0.5) / (total.sum() + 0.5 * len(total))
        self.follow = (total + SMOOTH * share) / (total.sum(1, keepdims=True) + SMOOTH)
        self.mass = np.maximum(total.sum(0), 1e-9)
        #: tokens and distinct words of the rare
        self.rest, self.rest_words = float(total.sum(0)[classes + 1]), max(0, rest_words)

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))

    def of(self, words: np.ndarray, c: np.ndarray, placed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and probability within it, of each word with its count and the class it is placed in (-1: none)."""
        n = len(self.known)
        rest = (c + 0.5) / (self.rest + 0.5 * (self.rest_words + 1))
        own = np.where(placed >= 0, placed, self.classes + 1)
        if n:
            at = np.minimum(np.searchsorted(self.known, words), n - 1)
            own = np.where(self.known[at] == words, self.own[self.order[at]], own)
        return own, np.where(own <= self.classes, c / self.mass[own], rest)

    def score(self, words: np.ndarray, c: np.ndarray, placed: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score of each text."""
        own, inner = self.of(words, c, placed)
        end = len(words)
        own, inner, c = np.append(own, self.classes), np.append(inner, 1.0), np.append(c, self.ends)
        after, before = _before(tokens, counts, end)
        base = self.base(c)
        p = MIX * self.follow[own[before], own[after]] * inner[after] + (1 - MIX) * base[after] if self.tokens else base[after]
        first = np.cumsum(counts + 1) - counts - 1
        return tuple(np.add.reduceat(x, first) for x in ((c > 0)[after].astype(np.int64), np.log10(base)[after], np.log10(p)))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, held, counts, words, tokens, known in zip(*(batch.column(i) for i in range(6)), strict=True):
                held, counts, words = _open(held.as_py(), "u1") > 0, _open(counts.as_py(), "<i8"), np.frombuffer(words.as_py(), np.int64)
                c, placed = np.zeros(len(words), np.int64), np.full(len(words), -1)
                if known.is_valid:
                    at, n, kind = (known.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
                    c[at], placed[at] = n, kind
                seen, base, score = model.score(words, c, placed, _open(tokens.as_py(), "<u4").astype(np.int64), counts)
                yield pa.RecordBatch.from_pydict({"doc_id": ids.values.slice(0) if len(ids.values) == len(counts) else pa.array(ids.as_py(), pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(counts + 1), "n_known": pa.array(seen), "train_tokens": pa.array(np.full(len(counts), model.tokens)), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, classes: int = CLASSES, common: int = COMMON) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    scratch = store.Scratch()
    held = F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 1, false)")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", held.alias("held"), "text")
    blocks = scratch.written(rows.mapInArrow(_blocks, _BLOCK), "blocks")
    vocabulary = scratch.written(blocks.select("words", "train").mapInArrow(_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "vocabulary")
    n, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = rows.where("not held").count()
    # HEAD rows at most
    top = np.array([r.h for r in vocabulary.orderBy(F.desc("c"), "h").limit(head).collect()], np.int64)
    # (HEAD + 2) ** 2 rows at most
    parts = blocks.select("words", "held", "counts", "tokens")
    table = parts.mapInArrow(_bigrams(top), "code long, c long").groupBy("code").agg(F.sum("c").alias("c")).toArrow()
    pairs = np.zeros((len(top) + 2) ** 2)
    pairs[table["code"].to_numpy()] = table["c"].to_numpy()
    pairs = pairs.reshape(len(top) + 2, -1)
    own = exchange(pairs, classes)
    one = np.zeros((len(own), classes + 2))
    one[np.arange(len(own)), own] = 1
    total = one.T @ pairs @ one

    # the other words that are common enough: a sieve keeps the rare ones out of the shuffle
    some = scratch.written(store.sieve(vocabulary.where(F.col("c") >= common).select("h")), "sieve")
    near = store.sifted(parts.mapInArrow(_neighbours(top, own, classes), "h long, code short, n long"), some, F.col("h")).where("maybe")
    near = near.groupBy("h", "code").agg(F.sum("n").alias("n")).repartition("h").sortWithinPartitions("h", "code")
    placed = scratch.written(near.mapInArrow(_placed(total, total.sum(0), classes, common), "h long, class int, code int, n long"), "placed")
    sums = placed.groupBy("class", "code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((classes + 2, 2 * classes + 4))
    counts[sums["class"].to_numpy(), sums["code"].to_numpy()] = sums["n"].to_numpy()
    total = spread(total, counts[:, classes + 2 :], counts[:, : classes + 2].T)
    kinds = placed.groupBy("h").agg(F.min("class").alias("class"))
    in_class = len(top) + (ends > 0) + kinds.count()
    model = Model(top, own, total, int(n) + ends, distinct + (ends > 0), ends, distinct + (ends > 0) - in_class, classes)

    # the counts and classes of its words, a row for each block
    told = vocabulary.join(kinds, "h", "left").select("h", "c", F.coalesce("class", F.lit(-1)).cast("short").alias("class"))
    found = blocks.select("block", "words").mapInArrow(_asked, "block long, pos int, h long").join(told, "h").groupBy("block").agg(F.collect_list(F.struct("pos", "c", "class")).alias("known"))
    scored = blocks.join(found, "block", "left").select("ids", "held", "counts", "words", "tokens", "known").mapInArrow(_scored(model), SCHEMA)
    return scratch.finish(scored, "scores")
