"""Line dedup by overlapping windows of three lines, in DataFrame functions alone.

Lines end at a line feed.  Every run of WINDOW lines of a text is fingerprinted
(128 bits); of all occurrences of a window in the corpus the one with the least
(document id, position) stays, and each later one covers its lines.  The lines
that later occurrences cover are removed, runs of them merged; the other lines
stay in order.  A text of fewer lines than a window is left as it is.

Null text stays null, and an empty one has one empty line.  A text's lines are
one array in a task, so the longest text sets its memory.  Where ids repeat or are null, rows are told apart by a
fingerprint of their text and then count as one text; rows of equal id and
equal text are the same document and stay as they are beside each other.  A
document that loses all its lines stays, with an empty text.  Of occurrences
that tie in id, the one of the least text fingerprint and position stays.  An
empty table gives an empty result.  Columns of docs may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

WINDOW = 3


def _prints(lines: Column, size: int) -> Column:
    """(a, b, position) of each window; an empty array for fewer lines."""
    return F.when(F.size(lines) < size, F.expr("cast(array() as array<struct<a: bigint, b: bigint, at: int>>)")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.size(lines) - size),
            lambda i: F.struct(F.xxhash64(*[F.get(lines, i + j) for j in range(size)]).alias("a"), F.xxhash64(F.lit(size), *[F.get(lines, i + j) for j in reversed(range(size))]).alias("b"), i.alias("at")),
        )
    )


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Later occurrences of repeated windows: id, tie (fingerprint of the text), at (first line, from 0)."""
    found = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .where(F.col("text").contains("\n"))
        .select("id", F.xxhash64("text").alias("tie"), F.split("text", "\n").alias("lines"))
        .select("id", "tie", F.explode(_prints(F.col("lines"), size)).alias("w"))
        .select("id", "tie", "w.a", "w.b", "w.at")
    )
    # partial sums come before the shuffle, so a window with any number of copies is one row per task
    first = found.groupBy("a", "b").agg(F.min(F.struct("id", "tie", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    # written, so that the join deals out both sides and a window with very many copies can be split
    first = store.written(first, "windows")
    # a copy of the whole row is no later occurrence
    return found.join(first, ["a", "b"]).where(~F.struct("id", "tie", "at").eqNullSafe(F.col("first"))).select("id", "tie", "at")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """docs with the texts deduplicated, and two more columns: lines_in and lines_removed (int), with underscores before them where docs have such columns."""
    own = list(docs.columns)
    lines_in, lines_removed = store.fresh(own, "lines_in", "lines_removed")
    id_, tie, start_, stop_, lines_, kept_ = store.fresh([*own, lines_in, lines_removed], "id", "tie", "from", "to", "lines", "kept")
    # starts of the windows to remove, then first line and length of each merged run of covered lines
    at = F.col("at")
    cover = (
        repeated(docs, id_col, text_col, size)
        .groupBy("id", "tie")
        .agg(F.array_sort(F.collect_set("at")).alias("at"))
        .select(
            F.col("id").alias(id_),
            F.col("tie").alias(tie),
            F.filter(at, lambda x, i: (i == 0) | (x - F.get(at, i - 1) > size)).alias(start_),
            F.transform(F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) - x > size)), lambda x: x + size).alias(stop_),
        )
    )
    lines, start, stop = F.col(lines_), F.col(start_), F.col(stop_)

    def between(k: Column) -> Column:
        first = F.when(k == 0, F.lit(0)).otherwise(F.get(stop, k - 1))
        return F.slice(lines, first + 1, F.coalesce(F.get(start, k), F.size(lines)) - first)

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(start)), between))
    return (
        docs.join(cover, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text_col) == F.col(tie)), "left")
        .withColumn(lines_, F.split(F.col(text_col), "\n"))
        .withColumn(kept_, F.when(start.isNotNull(), kept))
        .select(
            *[F.when(start.isNull(), F.col(c)).otherwise(F.array_join(kept_, "\n")).alias(c) if c == text_col else F.col(c) for c in own],
            F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(lines)), F.lit(0)).alias(lines_in),
            F.coalesce(F.when(start.isNotNull(), F.size(lines) - F.size(kept_)), F.lit(0)).alias(lines_removed),
        )
    )
