"""Bit tables of fixed size that tell which hashes are surely not among many."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 22  # leading bits of a hash; the table has 512 KB at any size of the data


def bit_table(rows: DataFrame, column: str) -> np.ndarray:
    """One bit per value of the leading bits of ``column`` (a long), set if a row has it.

    The bits are put together on the executors: the driver gets 65,536 numbers at most.
    """
    at = F.shiftrightunsigned(F.col(column), 64 - BITS)
    words = rows.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(63).cast("int").alias("bit"))
    words = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    table = np.zeros(1 << (BITS - 6), np.uint64)
    for r in words.collect():
        table[r.word] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)
    return table


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITS)
    return ((table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
