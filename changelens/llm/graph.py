"""Connected components of a graph of links, without any large group in one task.

Links are first contracted within each partition (a union-find over the rows of
one task).  Up to ONE links then meet in one task, which ends it; of more, large-star
and small-star steps alternate until nothing changes or so few are left.  Either
way is exact.  Links that come later only contract the roots that they lead to
(`joined`), so work follows the new links.  Least neighbours are found by partial sums, and the joins that follow
have a unique side, so Spark can split the rows of a node with many links.
Each step is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

_PAIR = "a long, b long"
#: Links that one task contracts (a few MB).
ONE = 1 << 16


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A link from each node of the partition to the least node that its links lead to."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = parent.setdefault(min(x, y), min(x, y))
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 1 << 16):
        part = nodes[i : i + (1 << 16)]
        yield pa.RecordBatch.from_pydict({"a": pa.array(part, pa.int64()), "b": pa.array([root(x) for x in part], pa.int64())})


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: store.Scratch | None = None) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node reachable.  Roots have no row."""
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a != b")
    now = store.written(links.mapInArrow(_contract, _PAIR), "links")
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        few = state[0] <= ONE
        if state != seen and state[0]:
            old, seen = now, state
            now = store.written(now.repartition(1).mapInArrow(_contract, _PAIR) if few else _small_star(_large_star(now)), "links")
            store.drop(old)
            if not few:
                continue
        if scratch:
            scratch.tables.append(now)
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def at_roots(links: DataFrame, root: DataFrame) -> DataFrame:
    """The links (a, b) whose ends have different roots, with those (ra, rb)."""
    for side in ("a", "b"):
        links = links.join(root.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
    return links.where("ra != rb")


def joined(root: DataFrame, more: DataFrame, scratch: store.Scratch) -> DataFrame:
    """What components() would return of the links that gave root and of more."""
    moved = components(at_roots(more, root), "ra", "rb", scratch)
    tops = moved.select(F.col("node").alias("root"), F.col("root").alias("top"))
    # an old root has no row in root, so each node comes once
    return scratch.written(root.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(moved), "roots")
