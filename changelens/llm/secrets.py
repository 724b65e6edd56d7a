"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

The base patterns (assign, access, hex) always report.  The network looks at
every other candidate: a run of at least SHORTEST characters of the value
alphabet, in CONTEXT characters on each side.  It slides over longer runs in
windows of SPAN characters, each half over the one before, and a run is reported
where one of its windows is.  It
is a one-dimensional convolution over one-hot character classes of the context
and the candidate, maximum and mean pooling, and a logistic output, in numpy.

Labelled findings to train on are made from the corpus: candidates that a base
pattern reports are secrets, those that no pattern reports, in documents
without any report, are not; and made-up findings of many forms and lengths are
added from a fixed seed, in contexts that the patterns do not know.  At most
SAMPLE candidates of each label are used, of least hash.  Three fifths train,
one fifth calibrates the scores (Platt), and on the last one the threshold is
the highest at which RECALL of its secrets are reported; nothing overrides it.

Null and empty texts have no spans.  Rows of equal or null id are scanned each
for itself.  A text is never divided, so the longest one sets the memory of a
task.  Equal candidates in equal contexts get equal scores, and of candidates
that overlap a base span the span stays.  Without candidates that are no secrets
only base spans are reported.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .toxicity import curve

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SHORTEST, CONTEXT, WIDTH = 8, 16, 64
SPAN = WIDTH - 2 * CONTEXT
SAMPLE, RECALL = 4000, 0.99
FILTERS, REACH, ROUNDS = 16, 5, 400

_VALUE = np.array([chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-" for b in range(256)])
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])


def _classes() -> np.ndarray:
    """Class of each byte; 0 stands for padding."""
    out = np.ones(256, np.int64)  # anything else
    for c, chars in enumerate((" \t\r\n", "0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "=:", "\"'`", "_-", "./", "+", "(){}[]<>", ",;!?"), 2):
        out[[ord(x) for x in chars]] = c
    out[0x80:] = 15
    return out


_CLASS = _classes()
_N = 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, in order."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs in which mask holds, cut at the texts' ends."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    on = np.append(mask, False)
    start = on & (edge | ~np.append(False, mask))
    start[-1] = False
    before = np.append(False, mask)
    stop = before & (edge | ~on)
    return np.flatnonzero(start), np.flatnonzero(stop)


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of all windows of runs of value characters that are long enough, and of the run of each."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 4
    a, b = _runs(_VALUE[data], offsets)
    long = b - a >= SHORTEST
    a, b = a[long], b[long]
    n = 1 + -(-np.maximum(b - a - SPAN, 0) // (SPAN // 2))
    step = tk.gather(np.zeros(len(n), np.int64), n)
    first, last = np.repeat(a, n), np.repeat(b, n)
    # the last window of a run ends with it
    start = np.maximum(np.minimum(first + step * (SPAN // 2), last - SPAN), first)
    return start, np.minimum(start + SPAN, last), first, last


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text could match a base pattern: it has a keyword's two letters by a sign, AKIA, or a long hex run."""
    raw = data.tobytes()
    hit = np.zeros(len(offsets) - 1, bool)
    low = raw.lower()
    for word in (b"passw", b"secret", b"token", b"apikey", b"api_key", b"akia"):
        at = low.find(word)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            hit[row] = True
            at = low.find(word, int(offsets[row + 1]))
    a, b = _runs(_DIGIT[data] | ((data >= 0x61) & (data <= 0x66)), offsets)
    hit[np.searchsorted(offsets, a[b - a >= 32], "right") - 1] = True
    return hit


def frames(data: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Character classes of each candidate window with its context: WIDTH places.

    CONTEXT characters before it, then its first and last (WIDTH - 2 * CONTEXT) / 2 characters, then CONTEXT after it.
    """
    row = np.searchsorted(offsets, a, "right") - 1
    first, last = offsets[row], offsets[row + 1]
    half = SPAN // 2
    parts = []
    for start, size, low, high in ((a - CONTEXT, CONTEXT, first, a), (a, half, a, b), (b - half, half, np.minimum(a + half, b), b), (b, CONTEXT, b, last)):
        at = start[:, None] + np.arange(size)
        inside = (at >= low[:, None]) & (at < high[:, None])
        parts.append(np.where(inside, _CLASS[data[np.clip(at, 0, len(data) - 1)]], 0))
    return np.concatenate(parts, 1)


@dataclass
class Network:
    filters: np.ndarray  # REACH, _N, FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0

    def layers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places = x.shape[1] - REACH + 1
        h = np.zeros((len(x), places, FILTERS)) + self.bias
        for r in range(REACH):  # the product with a one-hot vector is a row
            h += self.filters[r][x[:, r : r + places]]
        h = np.maximum(h, 0)
        return h, h.argmax(1), np.concatenate([h.max(1), h.mean(1)], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        """The logits of layers(), by tables of what the first three and the last two characters of each reach add."""
        f = self.filters.astype(np.float32)
        head = (f[0][:, None, None] + f[1][:, None] + f[2] + self.bias.astype(np.float32)).reshape(-1, FILTERS)
        tail = (f[3][:, None] + f[4]).reshape(-1, FILTERS)
        out, places = np.zeros(len(x)), x.shape[1] - REACH + 1
        for i in range(0, len(x), 256):
            c = x[i : i + 256].astype(np.intp)
            two = c[:, :-1] * _N + c[:, 1:]
            h = head.take(two[:, :places] * _N + c[:, 2 : 2 + places], 0)
            h += tail.take(two[:, 3 : 3 + places], 0)
            np.maximum(h, 0, out=h)
            out[i : i + 256] = h.max(1) @ self.out[:FILTERS] + h.mean(1) @ self.out[FILTERS:] + self.out_bias
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logit(x) + self.shift, -35, 35)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, size: int = 128) -> Network:
    """Adam over the logistic loss, a fixed seed."""
    rng = np.random.default_rng(11)
    net = Network(rng.normal(0, 0.3, (REACH, _N, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    names = ("filters", "bias", "out", "out_bias")
    m, v = ({n: np.zeros_like(getattr(net, n), dtype=float) for n in names} for _ in range(2))
    groups = [np.flatnonzero(y == c) for c in (0, 1)]
    for step in range(1, rounds + 1):
        at = np.concatenate([rng.choice(g, size // 2) for g in groups])
        own, target = x[at], y[at]
        h, best, pooled = net.layers(own)
        error = (1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -35, 35))) - target) / len(at)
        back = error[:, None] * net.out[None]
        dh = np.repeat(back[:, None, FILTERS:] / h.shape[1], h.shape[1], 1)
        n, f = np.meshgrid(np.arange(len(at)), np.arange(FILTERS), indexing="ij")
        dh[n, best, f] += back[:, :FILTERS]
        dh *= h > 0
        grad = {"out": pooled.T @ error + 1e-4 * net.out, "out_bias": error.sum(), "bias": dh.sum((0, 1)), "filters": np.zeros_like(net.filters)}
        for r in range(REACH):
            np.add.at(grad["filters"][r], own[:, r : r + h.shape[1]].reshape(-1), dh.reshape(-1, FILTERS))
        for k in names:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            setattr(net, k, getattr(net, k) - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
    return net


def made_up(n: int) -> list[tuple[str, int, int]]:
    """Findings of common forms in plain contexts, from a fixed seed: text, start, end."""
    rng = np.random.default_rng(5)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets, out = (upper + lower + digits, lower + digits, upper + digits, upper + lower + digits + "+/_.=-"), []
    heads, before = ("ghp_", "sk_live_", "xoxb-", "AIza", "glpat-", "npm_", "eyJ", "", "", ""), ("Authorization: Bearer ", "the credential is ", "auth=", "client: '", "export KEY=", "pwd: ", "pass: ", "pin=", "and of the ", "login with ", "")
    after = (" and then on", "'", '"', "\n", ", the ", "")
    for _ in range(n):
        head, alphabet = heads[rng.integers(len(heads))], alphabets[rng.integers(len(alphabets))]
        size = int(rng.integers(8, 20)) if not head and rng.integers(2) else int(rng.integers(20, 44))
        value = head + "".join(alphabet[i] for i in rng.integers(0, len(alphabet), size))
        lead = before[rng.integers(len(before))]
        out.append((lead + value + after[rng.integers(len(after))], len(lead), len(lead) + len(value)))
    return out


def _labelled(sample: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates of each text with their frames and labels: of each piece those of the SAMPLE least keys of a label, as no others are used."""
        for batch in batches:
            for first, _, data, offsets in tk.pieces(*tk.buffers(batch.column(1))):
                a, b, _, _ = candidates(data, offsets)
                row = np.searchsorted(offsets, a, "right") - 1
                label = np.zeros(len(a), np.int64)
                raw = data.tobytes()
                for t in np.unique(row[suspects(data, offsets)[row]]).tolist():
                    own = np.flatnonzero(row == t)
                    found = byte_spans(raw[offsets[t] : offsets[t + 1]].decode("utf-8", "replace"), int(offsets[t]))
                    hit = np.array([any(x < e and s < z for s, e, _ in found) for x, z in zip(a[own].tolist(), b[own].tolist(), strict=True)])
                    label[own] = np.where(hit, 1, -1 if found else 0)
                keys = tk.mix(tk.fingerprints(data, a, b, lower=False)).view(np.int64)
                use = np.concatenate([own[keys[own] <= np.unique(keys[own])[:sample][-1]] if len(own) else own for own in (np.flatnonzero(label == c) for c in (0, 1))])
                x = frames(data, offsets, a[use], b[use]).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"label": pa.array(label[use]), "key": pa.array(keys[use]), "frame": pa.array([r.tobytes() for r in x], pa.binary())})

    return run


def byte_spans(text: str, at: int = 0) -> list[tuple[int, int, int]]:
    """base_spans with places in UTF-8 bytes, from `at`."""
    found = base_spans(text)
    if text.isascii():
        return [(at + s, at + e, k) for s, e, k in found]
    return [(at + len(text[:s].encode()), at + len(text[:e].encode()), k) for s, e, k in found]


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Network:
    rows = docs.select(F.lit(0).alias("x"), F.col(text_col).alias("text")).mapInArrow(_labelled(sample), "label long, key long, frame binary")
    rows = rows.groupBy("label", "key").agg(F.min("frame").alias("frame"))
    picked = [rows.where(F.col("label") == c).orderBy("key").limit(sample) for c in (0, 1)]
    table = picked[0].union(picked[1]).toArrow()  # 2 * sample rows of WIDTH bytes
    order = np.lexsort((table["key"].to_numpy(), table["label"].to_numpy()))
    x = np.frombuffer(b"".join(table["frame"].to_pylist()), np.uint8).reshape(-1, WIDTH)[order].astype(np.int64)
    y = table["label"].to_numpy()[order]
    extra = made_up(max(256, int((y == 1).sum()) // 2))
    data, offsets = tk.buffers(pa.array([t for t, _, _ in extra]))
    more = frames(data, offsets, offsets[:-1] + [s for _, s, _ in extra], offsets[:-1] + [e for _, _, e in extra])
    x, y = np.concatenate([x, more]), np.concatenate([y, np.ones(len(more), np.int64)])
    if not (y == 0).any():  # nothing to tell them from
        return Network(np.zeros((REACH, _N, FILTERS)), np.zeros(FILTERS), np.zeros(2 * FILTERS), 0.0)
    part = np.arange(len(x)) % 5
    net = train(x[part < 3], y[part < 3])
    logit = net.logit(x[part == 3])
    net.scale, net.shift = curve(logit[:, None], y[part == 3].astype(float))
    found = np.sort(net.score(x[(part == 4) & (y == 1)]))
    net.threshold = float(found[int((1 - RECALL) * len(found))])
    return net


def scan(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_cnn, base_sha256, and spans (kind:start:end in code points, end exclusive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in tk.pieces(*tk.buffers(batch.column(1))):
                n = last - first
                base: list[list] = [[] for _ in range(n)]
                more: list[list] = [[] for _ in range(n)]
                raw = data.tobytes()
                texts: dict[int, str] = {}
                for t in np.flatnonzero(suspects(data, offsets)).tolist():
                    texts[t] = raw[offsets[t] : offsets[t + 1]].decode("utf-8", "replace")
                    base[t] = base_spans(texts[t])
                a, b, first_at, last_at = candidates(data, offsets)
                hit = np.concatenate([np.flatnonzero(net.score(frames(data, offsets, a[i : i + 4096], b[i : i + 4096])) >= net.threshold) + i for i in range(0, len(a), 4096)]) if len(a) else np.zeros(0, np.int64)
                runs, at = np.unique(first_at[hit], return_index=True)
                for start, end in zip(runs.tolist(), last_at[hit][at].tolist(), strict=True):
                    t = int(np.searchsorted(offsets, start, "right")) - 1
                    s = len(raw[offsets[t] : start].decode("utf-8", "replace"))
                    e = s + end - start  # value characters are ASCII
                    if not any(x < e and s < z for x, z, _ in base[t]):
                        more[t].append((s, e, 3))
                write = lambda found: ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in found)
                counts = [[sum(k == c for _, _, k in x) for x in base] for c in range(3)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(first, n), "n_assign": pa.array(counts[0], pa.int64()), "n_access": pa.array(counts[1], pa.int64()), "n_hex": pa.array(counts[2], pa.int64()), "n_cnn": pa.array([len(x) for x in more], pa.int64()),
                    "base_sha256": pa.array([hashlib.sha256(write(x).encode()).hexdigest() for x in base]), "spans": pa.array([write(sorted(x + y, key=lambda s: (s[0], s[2]))) for x, y in zip(base, more, strict=True)]),
                })

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_cnn long, base_sha256 string, spans string")
