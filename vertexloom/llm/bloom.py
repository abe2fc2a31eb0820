"""A blocked Bloom filter in plain SQL functions.

A key's hash picks one 64-bit block and four bits in it, so a probe reads a single word. The
filter is one row with one array of longs, read as a scalar subquery. It grows with its keys, 16
bits for each, up to ``MAX_BLOCKS`` words (8 MB, four million keys): beyond that it lets more
rows through to the exact join which always follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 20
BITS_PER_KEY = 16


def mask(h: Column) -> Column:
    """Four bits of a block, from the upper bits of a 64-bit hash."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, s).bitwiseAND(F.lit(63)).cast("int")) for s in (40, 46, 52, 58)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def block(h: Column, blocks: int) -> Column:
    """The block of a hash; ``blocks`` is a power of two."""
    return h.bitwiseAND(F.lit(blocks - 1)).cast("int")


def blocks_for(keys: int) -> int:
    blocks = 64
    while blocks * 64 < keys * BITS_PER_KEY and blocks < MAX_BLOCKS:
        blocks *= 2
    return blocks


def build(hashes: DataFrame, keys: int) -> tuple[DataFrame, int]:
    """The filter of column ``h`` of ``hashes``, as a frame of one row and one column ``words``."""
    blocks = blocks_for(keys)
    spark = hashes.sparkSession
    empty = spark.range(blocks).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("m"))
    full = hashes.where("h IS NOT NULL").select(block(F.col("h"), blocks).alias("b"), mask(F.col("h")).alias("m"))
    words = full.unionAll(empty).groupBy("b").agg(F.bit_or("m").alias("m"))
    row = words.agg(F.sort_array(F.collect_list(F.struct("b", "m"))).alias("w")).select(F.col("w.m").alias("words"))
    return row, blocks


def might_hold(words: Column, h: Column, blocks: int) -> Column:
    m = mask(h)
    return F.get(words, block(h, blocks)).bitwiseAND(m) == m
