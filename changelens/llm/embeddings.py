"""Embedding near-dedup by collision counts over one-dimensional projections.

Within a label, equal vectors form a class and one representative goes on.
Representatives are ordered by the signs of their first CODE projections and cut
into blocks of BLOCK rows, so vectors that lie together mostly share a block.
Where two blocks meet, each of PROJECTIONS projections of the one block is
sorted, and every vector of the other is a query whose window is centred on its
own projection; binary search finds the run of sorted places in it.  For every
pair it is counted in how many windows the other vector falls.  Pairs whose
count passes a limit that a pair at the least cosine reaches with a chance of
1 - MISS are verified by cosine in double precision.  A first pass over FIRST
projections, with a limit of its own, spares most pairs the rest.

Two blocks meet only if their ranges are near enough for a window in as many
projections as the limit asks for, which loses no pair that could pass.  A
meeting of blocks reports how many vectors each of its vectors links with, and
links that join what belongs together, not all pairs; so a large group of near
copies costs rows in proportion to its vectors.  The meetings of one label are
dealt over the cluster.  Where a label's vectors do not gather in groups, the
count of comparisons grows with the square of its distinct vectors.

Vectors that are null, zero or hold null or non-finite components, and those
with a null label or id, link with nothing.  Vectors of different lengths never
link.  Components are read as doubles and scaled by the largest before squares
are taken, so very large and very small vectors count as well.  Rows of equal id
are vectors of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, store

PROJECTIONS, FIRST, BLOCK, CODE = 64, 24, 2048, 16
#: Shares that the meetings of one label are dealt in.
SHARES = 16
COSINE, MISS = 0.93, 1e-6
#: Half the width of a window, in standard deviations of the difference at the least cosine.
HALF = 1.5


def limit(n: int, chance: float, miss: float) -> int:
    """The largest count that n trials reach with a probability of 1 - miss at least."""
    below = 0.0
    for k in range(n + 1):
        below += comb(n, k) * chance**k * (1 - chance) ** (n - k)
        if below > miss:
            return k
    return n


def _calibrated(cosine: float) -> tuple[float, int, int]:
    """Half window, and the limits of both passes."""
    spread = sqrt(2 - 2 * cosine)
    chance = erf(HALF / sqrt(2))
    return HALF * spread, limit(FIRST, chance, MISS), limit(PROJECTIONS, chance, MISS)


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(13).normal(size=(dim, PROJECTIONS)).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def windows(p: np.ndarray, q: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each projection (column): the rank of each q, and the first rank and number of ranks in the window of each p."""
    rank, low, size = np.empty(q.shape, np.uint16), np.empty(p.shape, np.uint16), np.empty(p.shape, np.uint16)
    for k in range(q.shape[1]):
        order = np.argsort(q[:, k])
        rank[order, k] = np.arange(len(q))
        ordered = q[order, k]
        first = np.searchsorted(ordered, p[:, k] - half, "left")
        low[:, k], size[:, k] = first, np.searchsorted(ordered, p[:, k] + half, "right") - first
    return rank, low, size


def meet(x: np.ndarray, y: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit vectors x and y that link; x is y: each pair once.  Less than 2**16 rows each."""
    half, least_first, least = _calibrated(cosine)
    turn = directions(x.shape[1])
    rank, low, size = windows(x @ turn, y @ turn, half)
    ranks = np.ascontiguousarray(rank.T)
    out = []
    for a in range(0, len(x), 512):
        count = np.zeros((min(512, len(x) - a), len(y)), np.uint8)
        for k in range(FIRST):
            # unsigned: a rank below the window wraps round to a large number
            count += (ranks[k][None] - low[a : a + 512, k][:, None]) < size[a : a + 512, k][:, None]
        i, j = np.nonzero(count >= least_first)
        i += a
        if x is y:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 1 << 18):
            u, v = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
            more = count[u - a, v] + ((rank[v, FIRST:] - low[u, FIRST:]) < size[u, FIRST:]).sum(1)
            u, v = u[more >= least], v[more >= least]
            near = np.einsum("ij,ij->i", x[u], y[v]) >= cosine
            out.append((u[near], v[near]))
    return tuple(np.concatenate(z) if out else np.zeros(0, np.int64) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most BLOCK sorted rows of one label and length, with the range of each projection."""
    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

    def block(rows: list) -> pa.RecordBatch:
        nonlocal seq
        label, dim = rows[0][0], rows[0][1]
        p = np.frombuffer(b"".join(r[5] for r in rows), np.float64).reshape(len(rows), -1) @ directions(dim)
        row = {"label": pa.array([label], pa.int64()), "dim": pa.array([dim], pa.int32()), "block": pa.array([(part << 32) + seq]), "low": pa.array([p.min(0).tolist()], pa.list_(pa.float64())), "high": pa.array([p.max(0).tolist()], pa.list_(pa.float64()))}
        seq += 1
        row |= {"ids": pa.array([np.array([r[3] for r in rows], np.int64).tobytes()], pa.binary()), "sizes": pa.array([np.array([r[4] for r in rows], np.int64).tobytes()], pa.binary()), "vectors": pa.array([b"".join(r[5] for r in rows)], pa.binary())}
        return pa.RecordBatch.from_pydict(row)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (held[0][:2] != row[:2] or size == BLOCK):
                yield block(held)
                held, size = [], 0
            held.append(row)
            size += 1
    if held:
        yield block(held)


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, length, signs of the first projections, id, class size and the unit vector's bytes."""
    for batch in batches:
        lists = batch.column(3)
        size = np.asarray(batch.column(1)).astype(np.int64)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        at = np.concatenate([[0], np.cumsum(size)])
        code, raw = np.empty(len(size), np.int64), [b""] * len(size)
        for dim in np.unique(size).tolist():
            rows = np.flatnonzero(size == dim)
            x = unit(values[at[rows][:, None] + np.arange(dim)])
            code[rows] = (x @ directions(dim)[:, :CODE] > 0) @ (1 << np.arange(CODE))
            for i, row in zip(rows.tolist(), x, strict=True):
                raw[i] = row.tobytes()
        yield pa.RecordBatch.from_pydict({"label": batch.column(0), "dim": pa.array(size.astype(np.int32)), "code": pa.array(code), "vec_id": batch.column(2), "size": batch.column(4), "raw": pa.array(raw, pa.binary())})


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is joined with by the links."""
    root = np.arange(n)
    while len(i):
        old = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == old).all():
            break
    return root


def _met(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same = row["block"] == row["block2"]
                a, na = (np.frombuffer(row[c], np.int64) for c in ("ids", "sizes"))
                b, nb = (np.frombuffer(row[c], np.int64) for c in ("ids2", "sizes2"))
                x = np.frombuffer(row["vectors"], np.float64).reshape(len(a), -1)
                i, j = meet(x, x if same else np.frombuffer(row["vectors2"], np.float64).reshape(len(b), -1), cosine)
                if not len(i):
                    continue
                counts = np.zeros(len(a) + (0 if same else len(b)), np.int64)
                k = j if same else j + len(a)
                ids, sizes = (a, na) if same else (np.concatenate([a, b]), np.concatenate([na, nb]))
                np.add.at(counts, i, sizes[k])
                np.add.at(counts, k, sizes[i])
                root = _components(len(ids), i, k)
                own = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids[own]), "n": pa.array(counts[own]), "other": pa.array(ids[root[own]])})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (least id reachable), kept (its id is that)."""
    scratch = store.Scratch()
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.coalesce(v.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fine", fine).withColumn("h1", F.when(F.col("fine"), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("fine"), F.xxhash64(F.lit(1), "v", "label")))
    classes = scratch.written(rows.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")), "classes")
    reps = rows.where("fine").join(classes, ["h1", "h2"]).where("vec_id = rep").dropDuplicates(["h1", "h2"])
    flat = reps.select("label", F.size("v").alias("dim"), "vec_id", "v", "size").mapInArrow(_project, "label long, dim int, code long, vec_id long, size long, raw binary")
    flat = scratch.written(flat, "projected")
    order = flat.repartitionByRange("label", "dim", "code", "vec_id").sortWithinPartitions("label", "dim", "code", "vec_id")
    blocks = scratch.written(order.mapInArrow(_blocks, "label long, dim int, block long, low array<double>, high array<double>, ids binary, sizes binary, vectors binary"), "blocks")
    second = blocks.select("label", "dim", *[F.col(c).alias(f"{c}2") for c in ("block", "low", "high", "ids", "sizes", "vectors")])
    half, _, least = _calibrated(cosine)
    # in how many projections the ranges of two blocks are near enough for a window
    near = F.size(F.filter(F.arrays_zip("low", "high", "low2", "high2"), lambda r: (r["low2"] <= r["high"] + half) & (r["low"] <= r["high2"] + half)))
    one = blocks.select("label", "dim", "block", "low", "high", (F.xxhash64("block") % SHARES).alias("share"))
    two = second.select("label", "dim", "block2", "low2", "high2", F.explode(F.sequence(F.lit(1 - SHARES), F.lit(SHARES - 1)).cast("array<bigint>")).alias("share"))
    pairs = one.join(two, ["label", "dim", "share"]).where(F.col("block") <= F.col("block2")).where(near >= least)
    pairs = pairs.select("block", "block2").repartition("block", "block2").join(blocks.select("block", "ids", "sizes", "vectors"), "block").join(second.select("block2", "ids2", "sizes2", "vectors2"), "block2")
    found = scratch.written(pairs.mapInArrow(_met(cosine), "vec_id long, n long, other long"), "met")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n")).withColumnRenamed("vec_id", "rep")
    roots = graph.components(found.select(F.col("vec_id").alias("a"), F.col("other").alias("b")), scratch=scratch).withColumnRenamed("node", "rep")
    by_class = classes.join(counts, "rep", "left").join(roots, "rep", "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("root", "rep").alias("root"))
    out = rows.select("vec_id", "h1", "h2").join(by_class, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(True)).alias("kept")
    )
    return scratch.finish(out)
