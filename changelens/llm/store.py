"""Intermediate tables of the operators, and sieves that stand for sets of keys of any size."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import drop, new_path, shared_dir, written

__all__ = ["Scratch", "drop", "fresh", "new_path", "release", "shared_dir", "sieve", "sifted", "written"]

#: A sieve has 2**SIEVE_BITS words of 64 bits at most, so what is broadcast of it has this bound whatever the number of keys.
SIEVE_BITS = 19


class Scratch:
    """Written tables that go once a result that is made of them is written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(written(df, name))
        return self.tables[-1]

    def finish(self, df: DataFrame, name: str = "result") -> DataFrame:
        out = written(df, name)
        for table in self.tables:
            drop(table)
        self.tables = []
        return out


def release() -> None:
    """Gives the system back what freed arrays of this process still hold (as far as its C library can)."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it in any case."""
    have, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def _hash(*keys: Column) -> Column:
    return F.xxhash64(*keys)


def sieve(keys: DataFrame) -> DataFrame:
    """(word, bits): a bit for the hash of each row of keys, in at most 2**SIEVE_BITS words.

    A key is always found in it; others are found by chance, the more the more
    keys there are.  So it only spares work, and an exact step has to follow.
    """
    hashed = keys.select(_hash(*keys.columns).alias("h"))
    return hashed.groupBy(F.shiftrightunsigned("h", 64 - SIEVE_BITS).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits"))


def sifted(df: DataFrame, words: DataFrame, *keys: Column, name: str = "maybe") -> DataFrame:
    """df with a boolean column, true for every row whose keys went into the sieve (and for few others)."""
    h, word, bits = fresh([*df.columns, name], "h", "word", "bits")
    some = F.broadcast(words.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    rows = df.withColumn(h, _hash(*keys)).join(some, F.shiftrightunsigned(h, 64 - SIEVE_BITS) == F.col(word), "left")
    return rows.withColumn(name, F.coalesce(F.expr(f"shiftright(`{bits}`, cast(`{h}` & 63 as int)) & 1 = 1"), F.lit(False))).drop(h, word, bits)
