"""Toxicity by compression distance to two zstandard dictionaries.

A text is written as codes: each word becomes two of CODE bytes, one drawn from
its first STEM bytes and one from the whole word, so that a hit in a dictionary
is worth the same for any word, and inflected words meet.  Windows of WINDOW
words are compressed with a dictionary of toxic text, with one of ordinary text,
and with none; the differences of the lengths say which text a window is closer
to.  A logistic
curve over the largest, second largest and mean differences of a text gives its
score.

The dictionaries are lexicons: a class's dictionary has the codes of all stems
and words that it has clearly more often than the other class (lower bound of
the log odds over document counts), however many those are, from at most SAMPLE
labelled rows of each class.  Where neither class has any, they have all codes
of their class.  Words that tell nothing are left out, as their chance hits
would drown the others.  The curve is fitted to each half scored by dictionaries
of the other, and the model's dictionaries come from both.  The sample is the
rows of least hash of the document id, whatever the size of the corpus, and rows
of over SAMPLE_BYTES bytes are left out of it.

Null text counts as empty.  A text without words scores as the mean ordinary
text.  Rows of equal or null id are scored each for itself, and equal texts get
equal scores; rows of null id are never learned from, and of an id with several
labels one counts.  A text is never divided, so the longest one sets the memory
of a task.  Where the labels lack either class, every score is 0.  An empty
table gives an empty result.  Kept columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textkernel as tk

STEM, CODE, WINDOW = 5, 16, 24
LEVEL = 3
#: Labelled rows of each class at most, and the longest of them in bytes.
SAMPLE, SAMPLE_BYTES = 3000, 1 << 15
#: A stem or word marks a class from this lower bound of its log odds, in so many documents at least.
ODDS, LEAST = 1.0, 3
THRESHOLD = 0.3


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    plain: np.ndarray


def stems(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stem and whole word of each word in turn, and how many of both each text has."""
    starts, ends, counts = tk.spans(data, offsets, tk.ALNUM)
    whole = tk.mix(tk.fingerprints(data, starts, ends))
    return np.stack([tk.fingerprints(data, starts, np.minimum(ends, starts + STEM)), whole], 1).reshape(-1), 2 * counts


def codes(stem: np.ndarray) -> bytes:
    return np.stack([stem, tk.mix(stem)], 1).tobytes()


def windows(stem: np.ndarray, counts: np.ndarray, size: int) -> tuple[list[bytes], np.ndarray]:
    """The codes of each window, and how many windows each text has."""
    raw = codes(stem)
    out, at = [], 0
    for n in counts.tolist():
        end = (at + n) * CODE
        out += [raw[i : min(i + size * CODE, end)] for i in range(at * CODE, end, size * CODE)]
        at += n
    return out, -(-counts // size)


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """The hash tables have more places than the dictionary has bytes; the level's own would lose most codes of a large one."""
    made = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    wide = max(17, len(dictionary).bit_length() + 1)
    held = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(dictionary), window_log=wide, hash_log=wide, chain_log=wide, strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
    made.precompute_compress(compression_params=held)
    return zstandard.ZstdCompressor(compression_params=held, dict_data=made)


_BARE = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(stem: np.ndarray, counts: np.ndarray, toxic, ordinary) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the largest, second largest and mean of two differences, and whether it has words.

    The differences: how much shorter a window is with the toxic dictionary than
    with the ordinary one, and than without any.
    """
    found, n = windows(stem, counts, 2 * WINDOW)
    by_toxic, by_ordinary, bare = toxic.compress, ordinary.compress, _BARE.compress
    sizes = np.array([(len(by_ordinary(w)), len(bare(w)), len(by_toxic(w))) for w in found], np.float64).reshape(-1, 3)
    out, full = np.zeros((len(counts), 6)), n > 0
    if full.any():
        first = (np.cumsum(n) - n)[full]
        row = np.repeat(np.arange(int(full.sum())), n[full])
        for k in (0, 1):
            gain = sizes[:, k] - sizes[:, 2]
            top = np.maximum.reduceat(gain, first)
            best = np.flatnonzero(gain == top[row])
            rest = gain.copy()
            rest[best[np.unique(row[best], return_index=True)[1]]] = -np.inf
            second = np.maximum.reduceat(rest, first)
            out[full, 3 * k : 3 * k + 3] = np.stack([top, np.where(np.isfinite(second), second, top), np.add.reduceat(gain, first) / n[full]], 1)
    return out, full


def document_counts(stem: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    order = np.lexsort((row, stem))
    stem, row = stem[order], row[order]
    new = np.ones(len(stem), bool)
    new[1:] = (stem[1:] != stem[:-1]) | (row[1:] != row[:-1])
    return np.unique(stem[new], return_counts=True)


def marks(own: tuple, other: tuple, n_own: int, n_other: int, odds: float) -> np.ndarray:
    """The stems and words that one class has clearly more often than the other, the clearest last."""
    key, n = own
    at = np.minimum(np.searchsorted(other[0], key), max(0, len(other[0]) - 1))
    m = np.where(other[0][at] == key, other[1][at], 0) if len(other[0]) else np.zeros(len(key))
    low = np.log((n + 0.5) / (n_own + 1)) - np.log((m + 0.5) / (n_other + 1)) - 2 * np.sqrt(1 / n + 1 / (m + 0.5))
    low = np.where(n >= LEAST, low, -np.inf)
    order = np.argsort(low, kind="stable")
    return key[order][low[order] > odds]


def curve(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic curve over the columns and a constant, by Newton's method with step halving."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    keep = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + keep @ (w * w) / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """A model from labelled rows whose crc32(doc_id as text) mod 4 is not 2; None where a class is missing."""
    try:
        return _fit(docs, labels, id_col, text_col, label_col, sample)
    finally:
        store.release()  # the driver lives on


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> Model | None:
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 4 != 2").dropDuplicates(["doc_id"])
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    table = rows.join(F.broadcast(picked[0].union(picked[1])), "doc_id").toArrow()  # 2 * sample ids
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = table["y"].to_numpy()
    half = (tk.mix(table["doc_id"].to_numpy().astype(np.uint64)) & np.uint64(1)).astype(bool)
    # piece by piece, as the kernels take several times the bytes of what they work on
    parts = [stems(piece, own) for _, _, piece, own in tk.pieces(*tk.buffers(table["text"]))] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    stem, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    table = table.drop(["text"])
    ends = np.cumsum(counts)
    if not all(((y == c) & (half == h)).any() for c in (0, 1) for h in (False, True)):
        return None

    def of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(rows)
        return stem[tk.gather(ends[at] - counts[at], counts[at])], counts[at]

    def dictionaries(rows: np.ndarray) -> tuple[bytes, bytes]:
        toxic, ordinary = of((y == 1) & rows), of((y == 0) & rows)
        a, b = document_counts(*toxic), document_counts(*ordinary)
        n, m = len(toxic[1]), len(ordinary[1])
        keep = marks(a, b, n, m, ODDS), marks(b, a, m, n, 0.0)
        if not any(map(len, keep)):
            keep = a[0], b[0]
        return tuple(codes(k).rjust(CODE, b"\0") for k in keep)

    # each half is scored by dictionaries of the other; the model's own come from both
    folds = []
    for part in (half, ~half):
        x, full = features(*of(~part), *map(compressor, dictionaries(part)))
        folds.append((x[full], y[~part][full]))
    x, target = (np.concatenate(z) for z in zip(*folds, strict=True))
    share = float(known.agg(F.avg("y")).first()[0])
    w = curve(x, target.astype(float)) if len(x) else np.zeros(7)
    # from the shares of the classes in the sample to those in the labels
    seen = float(target.mean()) if len(x) else share
    if 0 < share < 1 and 0 < seen < 1:
        w[-1] += math.log(share / (1 - share)) - math.log(seen / (1 - seen))
    plain = x[target == 0]
    return Model(*dictionaries(np.ones(len(y), bool)), w, plain.mean(0) if len(plain) else np.zeros(6))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns in keep (the id if none are named), then the score under `name`, one row per row of docs."""
    keep = keep or [id_col]
    own = store.fresh([*keep, name], "text")[0]
    schema = docs.select(*keep).schema.add(name, "double")
    names = [*keep, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = None
        for batch in batches:
            out = []
            if model:
                pair = pair or (compressor(model.toxic), compressor(model.ordinary))
                for _, _, data, offsets in tk.pieces(*tk.buffers(batch.column(batch.num_columns - 1))):
                    x, full = features(*stems(data, offsets), *pair)
                    x[~full] = model.plain
                    out.append(1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ model.weights, -35, 35))))
            found = np.concatenate(out) if out else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=names)

    return docs.select(*keep, F.col(text_col).alias(own)).mapInArrow(run, schema)
