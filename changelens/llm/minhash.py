"""MinHash near-dedup by an LSH forest of sorted signature orders.

Texts become sets of word shingles (64-bit fingerprints).  Equal sets are one
class, and only the least id of each class, its representative, goes on.  Each
of TREES orders sorts the signatures by a run of DEPTH hashes of their own, and
each row takes the WIDTH rows before it as candidates as long as they share at
least FLOOR leading hashes: next to each other stand the rows of longest common
prefix, so the depth at which rows meet is as deep as their region of the order
is dense.  Rows at the edges of partitions meet in passes of their own.

Each row carries a byte of each of its hashes, so candidates whose signatures
agree too seldom for a similar pair (about five standard deviations) are dropped
where they meet, without a join, and the others are confirmed on full sets.
Every text first meets its NEAREST best candidates; candidates that these links
do not join yet are all confirmed after that, so groups of many copies cost a
few comparisons per text and components lose nothing.

Rows that had more than WIDTH rows of their prefix beside them stand in a crowded
region, where WIDTH rows are not all.  There, all rows that share DEEP hashes in an
order are one bucket (a pair at the least similarity is in one with a chance of
0.9998), whole and without a limit: every pair of a bucket that no link joins yet
and whose signatures agree often enough is confirmed on its full sets.  As the
sets stand beside each other for that, a bucket gives links that join components
and no pairs, fewer than it has rows.  Rows that agree with many come first, so a
text that all others of a group are copies of joins them at once.  Pairs that meet
in several orders are compared in the first.  Orders go in ROUNDS, each on what is
still apart after the last.  Only a region of many texts that are alike, but too
little to link, costs the square of its rows in CPU; a bucket's sets are dealt to
tasks in pairs of blocks of _ROOM shingles, which bounds the memory of a task.

The texts are read twice and never shuffled: once for signatures, and once for
the full sets of the texts that have a candidate, which a sieve of bounded size
picks (a few others by chance, which no pair asks for).

Empty and null texts have an empty set and link with nothing.  A text of fewer
words than a shingle has its whole sequence as one; the longest text sets the
memory a task needs (12 bytes for each of its bytes or so).  Rows of equal id
are each judged by their own text.  A row of null id joins the component of its
class; it represents none.  Ties between candidates are broken by a hash of
their ids.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, store
from . import textkernel as tk

TREES, DEPTH, WIDTH, FLOOR, DEEP = 16, 12, 3, 2, 4
#: Orders whose buckets are compared together.
ROUNDS = (range(2), range(2, 6), range(6, TREES))
NEAREST = 3
#: Similarity of 0.8 and over, as 100 * intersection >= 80 * union.
PERCENT = 80
#: Each order starts at a hash of its own and goes on over the next ones, round the signature.
_STEP = 6
_HASHES = TREES * _STEP
#: Rows that the last pass over edges takes in one task.
_ONE = 1 << 16
#: Shingles of a block of rows; a task holds the sets of two blocks (or of one text, if that has more).
_ROOM = 1 << 20
#: 5 standard deviations below the mean number of agreeing hashes at 0.8.
_AGREE = int(0.8 * _HASHES - 5 * (_HASHES * 0.8 * 0.2) ** 0.5)
_U = np.uint64
_rng = np.random.default_rng(7)
_FLIP, _TIMES = (_rng.integers(1, 1 << 63, _HASHES, dtype=np.uint64) * _U(2) + _U(1) for _ in range(2))


def sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted within each, and the size of each set."""
    hashes, _, _, counts = tk.words(data, offsets, tk.NON_SPACE)
    found, have = tk.shingles(hashes, counts, k)
    # by text, then by fingerprint; pieces have less than 2**16 texts
    order = np.argsort(found)
    row = np.repeat(np.arange(len(have), dtype=np.uint16), have)[order]
    again = np.argsort(row, kind="stable")
    found, row = found[order][again], row[again]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[new], np.bincount(row[new], minlength=len(have))


def signatures(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least of each hash over each set that has a shingle."""
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(first), _HASHES), np.uint32)
    if len(first):
        spread = tk.mix(shingles)
        for i in range(_HASHES):
            out[:, i] = np.minimum.reduceat((((spread ^ _FLIP[i]) * _TIMES[i]) >> _U(32)).astype(np.uint32), first)
    return out


def heads(signs: np.ndarray) -> np.ndarray:
    """32 bits for the first DEEP hashes of each order; chance hits only add pairs to compare."""
    out = np.zeros((len(signs), TREES), np.uint64)
    for d in range(DEEP):
        out = tk.mix(out * _U(0x9E3779B97F4A7C15) + signs[:, (np.arange(TREES) * _STEP + d) % _HASHES])
    return out.astype(np.uint32)


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tk.pieces(*tk.buffers(batch.column(1))):
                found, sizes = sets(data, offsets, k)
                full = sizes > 0
                first = (np.cumsum(sizes) - sizes)[full]
                keys = []
                for salt in (1, 2):
                    sums = np.zeros(len(sizes), np.uint64)
                    if len(first):
                        sums[full] = np.add.reduceat(tk.mix(found ^ _U(salt << 52)), first)
                    keys.append(pa.array(sums.view(np.int64)))
                signs = signatures(found, sizes)
                tops = heads(signs)
                key, low, top = [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
                for i, at in enumerate(np.flatnonzero(full).tolist()):
                    key[at], low[at], top[at] = signs[i].astype(">u4").tobytes(), signs[i].astype(np.uint8).tobytes(), tops[i].tobytes()
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "tie": batch.column(2).slice(a, b - a), "n": pa.array(sizes), "k1": keys[0], "k2": keys[1], "trees": pa.array(key, pa.binary()), "low": pa.array(low, pa.binary()), "heads": pa.array(top, pa.binary())})

    return run


def _neighbours(edges: bool):
    """Pairs of each row and the WIDTH rows before it that share FLOOR hashes and agree often enough.

    Besides (tree -1) the rows whose window was full, and with edges the rows at both ends of the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(a, **have) -> pa.RecordBatch:
            types = {"b": pa.int64(), "agree": pa.int32(), "tree": pa.int32(), "key": pa.binary(), "low": pa.binary()}
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64())} | {c: pa.array(have.get(c, [None] * len(a)), t) for c, t in types.items()})

        def ends(tree, key, doc, low) -> pa.RecordBatch:
            return block(doc, tree=tree, key=[x.tobytes() for x in key], low=[x.tobytes() for x in low])

        tail: tuple | None = None
        head = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            key = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, DEPTH)
            doc = batch.column(2).to_numpy(zero_copy_only=False)
            low = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, _HASHES)
            if edges and head < WIDTH:
                yield ends(*(x[: WIDTH - head] for x in (tree, key, doc, low)))
                head += len(doc)
            if tail:
                tree, key, doc, low = (np.concatenate(x) for x in zip(tail, (tree, key, doc, low), strict=True))
            old = len(tail[0]) if tail else 0
            for step in range(1, min(WIDTH, len(doc) - 1) + 1):
                start = max(old, step)
                same = tree[start:] == tree[start - step : len(tree) - step]
                for d in range(FLOOR):
                    same &= key[start:, d] == key[start - step : len(key) - step, d]
                at = np.flatnonzero(same) + start
                if step == WIDTH and len(at):
                    full = np.unique(np.concatenate([doc[at], doc[at - step]]))
                    yield block(full, tree=np.full(len(full), -1))
                at = at[doc[at] != doc[at - step]]
                agree = (low[at] == low[at - step]).sum(1)
                at, agree = at[agree >= _AGREE], agree[agree >= _AGREE]
                if len(at):
                    x, y = doc[at], doc[at - step]
                    yield block(np.minimum(x, y), b=np.maximum(x, y), agree=agree)
            tail = tuple(x[-WIDTH:] for x in (tree, key, doc, low))
        if edges and tail:
            yield ends(*tail)

    return run


_FOUND = "a long, b long, agree int, tree int, key binary, low binary"


def candidates(reps: DataFrame, scratch: store.Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of representatives (doc_id, trees, low) that are neighbours in some tree, with the hashes they agree in (agree); and the ids (doc_id) whose window was full."""
    place = [F.struct(F.lit(t).alias("tree"), F.expr(f"substring(concat(trees, trees), {t * _STEP * 4 + 1}, {DEPTH * 4})").alias("key")) for t in range(TREES)]
    rows = reps.select(F.explode(F.array(*place)).alias("k"), "doc_id", "low").select("k.tree", "k.key", "doc_id", "low").repartitionByRange("tree", "key", "doc_id")
    found: list[DataFrame] = []
    while True:
        found.append(scratch.written(rows.sortWithinPartitions("tree", "key", "doc_id").mapInArrow(_neighbours(True), _FOUND), "neighbours"))
        ends = found[-1].where("b is null and tree >= 0").select("tree", "key", F.col("a").alias("doc_id"), "low").distinct()
        n = ends.count()
        if n <= _ONE:
            break
        # a few rows for each partition, so each pass has a small part of the last one's
        rows = ends.repartitionByRange(-(-n // _ONE), "tree", "key", "doc_id")
    found.append(scratch.written(ends.repartition(1).sortWithinPartitions("tree", "key", "doc_id").mapInArrow(_neighbours(False), _FOUND), "edges"))
    every = reduce(DataFrame.union, found)
    return scratch.written(every.where("b is not null").groupBy("a", "b").agg(F.max("agree").alias("agree")), "candidates"), every.where("tree = -1").select(F.col("a").alias("doc_id")).distinct()


def _agreement(low: np.ndarray, p: int) -> np.ndarray:
    """In how many hashes each row agrees with row p."""
    return np.bitwise_count(np.packbits(low == low[p], axis=1).view(np.uint32)).sum(1)


def _agreeing(low: np.ndarray, tops: np.ndarray, group: np.ndarray, p: int, tree: int) -> np.ndarray:
    """The rows of other groups that agree with row p often enough and meet it in no tree before this one."""
    near = (_agreement(low, p) >= _AGREE) & (group != group[p])
    at = np.flatnonzero(near)
    return at[(tops[at, :tree] != tops[p, :tree]).all(1)]


def _central(low: np.ndarray) -> np.ndarray:
    """All rows, those first that agree most with 64 rows all over the bucket (which only sets the order of work)."""
    some = np.unique(np.linspace(0, len(low) - 1, 64).astype(np.int64))
    return np.argsort(-sum(_agreement(low, p) for p in some).astype(np.int64), kind="stable")


def partnered(low: np.ndarray, tops: np.ndarray, group: np.ndarray, tree: int) -> np.ndarray:
    """Which rows of a bucket have a row of another group that _agreeing finds."""
    flag = np.zeros(len(low), bool)
    most = group == np.bincount(group).argmax()
    # each such pair has a row outside the largest group
    few = 2 * int((~most).sum()) < len(low)
    for p in _central(low):
        if most[p] if few else flag[p]:
            continue
        at = _agreeing(low, tops, group, p, tree)
        if len(at):
            flag[at] = flag[p] = True
            if flag.all():
                break
    return flag


def joining(shingles: list[np.ndarray], low: np.ndarray, tops: np.ndarray, group: np.ndarray, tree: int, percent: int) -> list[tuple[int, int]]:
    """Links between rows of a bucket that make of its groups what all its links would."""
    sizes = np.array([len(x) for x in shingles])
    first = np.cumsum(sizes) - sizes
    word = np.unique(np.concatenate(shingles), return_inverse=True)[1]
    own = np.zeros(int(word.max()) + 1, np.int32)
    most = group == np.bincount(group).argmax()
    group = group.copy()
    out = []
    for i, p in enumerate(_central(low)):
        # each pair between groups has a row outside the largest one; a few of its rows may join many at once
        if most[p] and i >= 16:
            continue
        at = _agreeing(low, tops, group, p, tree)
        at = at[100 * np.minimum(sizes[at], sizes[p]) >= percent * np.maximum(sizes[at], sizes[p])]
        if not len(at):
            continue
        mine = word[first[p] : first[p] + sizes[p]]
        own[mine] = 1
        shared = np.add.reduceat(own[word[tk.gather(first[at], sizes[at])]], np.cumsum(sizes[at]) - sizes[at])
        own[mine] = 0
        at = at[100 * shared >= percent * (sizes[at] + sizes[p] - shared)]
        if len(at):
            joined, which = np.unique(group[at], return_index=True)
            out += [(int(p), int(q)) for q in at[which]]
            group[np.isin(group, joined)] = group[p]
            if (group == group[0]).all():
                break
    return out


def _buckets(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each key (the first columns) that has several roots, of sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.ones(batch.num_rows, bool)
        new[1:] = False
        for c in range(keys):
            column = batch.column(c)
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        root = batch["root"].to_numpy()
        several = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        several[0] = several[-1] = True  # they may go on in other batches
        for a, b in zip(starts[several].tolist(), np.append(starts[1:], batch.num_rows)[several].tolist(), strict=True):
            key = tuple(batch.column(c)[a].as_py() for c in range(keys))
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _parts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hashes, heads, groups (one for each root) and tree of the rows of a bucket."""
    low = np.frombuffer(b"".join(rows["low"].to_pylist()), np.uint8).reshape(-1, _HASHES)
    tops = np.frombuffer(b"".join(rows["heads"].to_pylist()), np.uint32).reshape(-1, TREES)
    return low, tops, np.unique(rows["root"].to_numpy(), return_inverse=True)[1], rows["tree"][0].as_py()


_UNIT = "tree int, key binary, i int, j int, doc_id long, root long, low binary, heads binary"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket (tree, key) that have a partner of another root, dealt into pairs of blocks i, j."""
    for rows in _buckets(batches, 2):
        low, tops, group, tree = _parts(rows)
        at = np.flatnonzero(partnered(low, tops, group, tree))
        if not len(at):
            continue
        most = group[at] == np.bincount(group[at]).argmax()
        order = np.argsort(most, kind="stable")
        at, most = at[order], most[order]
        block = np.unique(np.cumsum(rows["n"].to_numpy()[at]) // _ROOM, return_inverse=True)[1]
        last, lone = int(block[-1]), int(block[~most][-1])
        # every pair of groups has a row in the blocks up to lone
        for i in range(lone + 1):
            for j in range(i + 1, last + 1) if last else (0,):
                some = rows.take(pa.array(at[(block == i) | (block == j)]))
                for c, x in (("i", i), ("j", j)):
                    some = some.append_column(c, pa.array(np.full(len(some), x, np.int32)))
                yield from some.select([c.split()[0] for c in _UNIT.split(", ")]).combine_chunks().to_batches(1 << 14)


def _joining(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches, 4):
            doc = rows["doc_id"].to_numpy()
            low, tops, group, tree = _parts(rows)
            found = joining([np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()], low, tops, group, tree, percent)
            x, y = (doc[[f[k] for f in found]] if found else doc[:0] for k in (0, 1))
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tk.pieces(*tk.buffers(batch.column(1))):
                found, sizes = sets(data, offsets, k)
                raw, ends = found.tobytes(), np.cumsum(sizes) * 8
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "shingles": pa.array([raw[e - 8 * n : e] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary())})

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_pydict({"a": batch.column(0).take(at), "b": batch.column(1).take(at)})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least id reachable), kept (the row's id is that), tie (fingerprint of the text)."""
    scratch = store.Scratch()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tied = texts.withColumn("tie", F.xxhash64("text"))
    rows = scratch.written(tied.mapInArrow(_features(k), "doc_id long, tie long, n long, k1 long, k2 long, trees binary, low binary, heads binary"), "features")
    classes = rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"))
    ids = classes.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    reps = scratch.written(rows.where("n > 0").join(ids, "doc_id", "left_semi").select("doc_id", "n", "trees", "low", "heads"), "representatives")

    def confirmed(some: DataFrame, full: DataFrame) -> DataFrame:
        sides = some.join(full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(full.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
        return scratch.written(sides.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long"), "confirmed")

    def sets_of(ids: DataFrame) -> DataFrame:
        words = scratch.written(store.sieve(ids), "sieve")
        some = store.sifted(texts, words, F.col("doc_id")).where("maybe").select("doc_id", "text")
        return scratch.written(some.mapInArrow(_set_rows(k), "doc_id long, shingles binary").distinct(), "sets")

    pairs, full_rows = candidates(reps, scratch)
    full = sets_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))
    ends = pairs.select("a", "b", "agree", F.col("a").alias("own")).union(pairs.select("a", "b", "agree", F.col("b").alias("own")))
    best = Window.partitionBy("own").orderBy(F.desc("agree"), F.xxhash64("a", "b"))
    first = scratch.written(ends.withColumn("k", F.row_number().over(best)).where(F.col("k") <= NEAREST).select("a", "b").distinct(), "nearest")
    root = graph.components(confirmed(first, full), scratch=scratch)
    more = confirmed(graph.at_roots(pairs.select("a", "b").join(first, ["a", "b"], "left_anti"), root).select("a", "b"), full)
    if not more.isEmpty():
        root = graph.joined(root, more, scratch)

    # buckets of crowded regions, whole
    crowded = scratch.written(reps.join(full_rows, "doc_id", "left_semi").select("doc_id", "n", "low", "heads"), "crowded")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for trees in ROUNDS:
        now = crowded.join(root.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        place = [F.struct(F.lit(t).alias("tree"), F.expr(f"substring(heads, {4 * t + 1}, 4)").alias("key")) for t in trees]
        members = now.select(F.explode(F.array(*place)).alias("k"), *now.columns).select("k.tree", "k.key", *now.columns)
        units = scratch.written(members.repartition(tasks, "tree", "key").sortWithinPartitions("tree", "key", "doc_id").mapInArrow(_units, _UNIT), "units")
        if units.isEmpty():
            continue
        missing = scratch.written(units.select("doc_id").distinct().join(full, "doc_id", "left_anti"), "missing")
        if not missing.isEmpty():
            full = full.union(sets_of(missing).join(missing, "doc_id", "left_semi"))
        beside = units.join(full, "doc_id").select("tree", "key", "i", "j", "doc_id", "root", "low", "heads", "shingles")
        more = scratch.written(beside.repartition(tasks, "tree", "key", "i", "j").sortWithinPartitions("tree", "key", "i", "j").mapInArrow(_joining(percent), "a long, b long"), "confirmed")
        if not more.isEmpty():
            root = graph.joined(root, more, scratch)
    found = classes.join(root.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("root", "rep").alias("root"))
    out = rows.select("doc_id", "tie", "n", "k1", "k2").join(found, ["k1", "k2", "n"], "left").withColumn("component_id", F.coalesce("root", "doc_id"))
    return scratch.finish(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "tie"), "judged")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are kept: one for each component, and one of rows that are equal in id and text.

    Rows that a sieve of the ids to look at does not find stay where they are;
    the few others are joined exactly.  Columns of docs may have any names.
    """
    found = near_duplicates(docs, id_col, text_col, k, percent).select("doc_id", "tie", "kept")
    verdict = found.groupBy("doc_id", "tie").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    tie, maybe, own, other, kept, n = store.fresh(docs.columns, "tie", "maybe", "own", "other", "kept", "n")
    verdict = store.written(verdict.select(F.col("doc_id").alias(own), F.col("tie").alias(other), F.col("kept").alias(kept), F.col("n").alias(n)), "verdict")
    words = store.written(store.sieve(verdict.select(own, other)), "sieve")
    key = F.col(id_col).cast("long")
    rows = store.sifted(docs.withColumn(tie, F.xxhash64(F.col(text_col))), words, key, F.col(tie), name=maybe)
    doubtful = rows.where(F.col(maybe)).join(verdict, key.eqNullSafe(F.col(own)) & (F.col(tie) == F.col(other)), "left").where(F.coalesce(F.col(kept), F.lit(True)))
    single = doubtful.where(F.coalesce(F.col(n), F.lit(1)) == 1).unionByName(doubtful.where(F.col(n) > 1).dropDuplicates([id_col, tie]))
    return rows.where(~F.col(maybe)).select(*docs.columns).unionByName(single.select(*docs.columns))
