"""Token ids of a corpus in Simple-8b shard images, in ascending document order.

Texts are dealt by ranges of the document id, so that each task encodes and
writes its range alone.  A row of the written table is one shard image
(see simple8b) of about SHARD_IDS ids; Spark's own writer commits the rows, so
lost executors leave no half-written files, on any store that Spark can write.

Null text counts as empty.  A null id comes first; rows of equal id are ordered
by their text; no row is dropped.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b, store
from . import textkernel as tk
from .tokens import PIECE_BYTES, Encoder, with_end

SHARD_IDS = 1 << 20

_SHARDS = "part int, seq int, before long, n_ids long, n_docs long, image binary"
_DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encodes each text of docs, adds the end id, and writes shard images to path."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, before = Encoder.at(tokenizer), TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def shard() -> pa.RecordBatch:
            nonlocal seq, before, held
            doc, null, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "before": pa.array([before]), "n_ids": pa.array([len(ids)]), "n_docs": pa.array([len(doc)]), "image": pa.array([simple8b.image(doc, null, counts, ids)], pa.binary())})
            seq, before, held = seq + 1, before + len(ids), []
            return row

        for batch in batches:
            doc = batch.column(0)
            null = np.asarray(doc.is_null())
            doc = doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = tk.buffers(batch.column(1))
            for a, b, piece, own in tk.pieces(data, offsets, PIECE_BYTES):
                ids, counts = with_end(*encoder.encode(piece, own), end)
                held.append((doc[a:b], null[a:b], counts, ids))
                if sum(len(x[3]) for x in held) >= shard_ids:
                    yield shard()
        if held:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    rows.mapInArrow(encode, _SHARDS).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, its ids, and how many ids stand before it."""
    return _read(spark, path, "doc_id long, start long, ids array<long>", lambda ids: ids)


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, and the CRC-32 of its ids as 32-bit integers."""
    return _read(spark, path, _DIGEST, None)


def _read(spark: SparkSession, path: str, schema: str, full) -> DataFrame:
    shards = spark.read.schema(_SHARDS).parquet(path)
    # one number for each task that wrote
    sums = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    first, total = {}, 0
    for part in sorted(sums):
        first[part], total = total, total + sums[part]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                doc, null, counts, ids = simple8b.read_image(raw.as_buffer())
                ends = np.cumsum(counts)
                out = {"doc_id": pa.array(doc, pa.int64(), mask=null), "start": pa.array(first[part] + before + ends - counts)}
                if full:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64)))
                else:
                    small = memoryview(ids.astype("<u4")).cast("B")
                    out |= {"n_tokens": pa.array(counts), "ids_crc32": pa.array([zlib.crc32(small[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)], pa.int64())}
                yield pa.RecordBatch.from_pydict(out)

    return shards.select("part", "before", "image").mapInArrow(decode, schema)


def encoded_digest(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """write_ids to the shared folder, then read_digest."""
    spark = docs.sparkSession
    path = store.new_path(spark, "ids")
    write_ids(docs, path, tokenizer, end)
    return read_digest(spark, path)
