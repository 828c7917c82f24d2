"""Filters over keys as bitmaps, in DataFrame operations only.

A filter has FILTER_BITS bits, one for each key's hash, as pieces of 4 KB. It never misses a
key that is in it and passes few others, which a join afterwards drops; far more keys than
bits only make it pass more. Its size is fixed, so it can be broadcast at any scale, and rows that
it stops are never shuffled. Null is a key like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8 MB as bits; a power of two.
FILTER_BITS = 1 << 26
PIECE_SHIFT = 15
PIECE_BITS = 1 << PIECE_SHIFT


def position(key: Column) -> Column:
    """The bit of a key; never null, see common.digest."""
    return F.xxhash64(key).bitwiseAND(F.lit(FILTER_BITS - 1))


def build_filter(keys: DataFrame, column: str = "digest") -> DataFrame:
    """piece, bits: at most FILTER_BITS / PIECE_BITS = 2,048 rows of 4 KB."""
    at = keys.select(position(F.col(column)).alias("at")).select(F.shiftright("at", PIECE_SHIFT).alias("piece"), F.pmod("at", F.lit(PIECE_BITS)).alias("bit"))
    return at.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))


def probe_filter(rows: DataFrame, bitmap: DataFrame, column: str = "digest") -> DataFrame:
    """The rows that the filter passes: all whose key is in it, and few others."""
    named = rows.withColumn("__at", position(F.col(column))).withColumn("__piece", F.shiftright("__at", PIECE_SHIFT))
    pieces = bitmap.select(F.col("piece").alias("__piece"), F.col("bits").alias("__bits"))
    byte = F.conv(F.hex(F.expr(f"substring(__bits, cast(pmod(__at, {PIECE_BITS}) div 8 as int) + 1, 1)")), 16, 10).cast("long")
    met = named.join(F.broadcast(pieces), "__piece")  # 8 MB at most, see build_filter
    return met.where(F.getbit(byte, F.pmod("__at", F.lit(8)).cast("int")) == 1).select(*rows.columns)
