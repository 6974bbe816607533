"""Bloom filters of many keys, built and probed by Spark's own functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of one bitmap of ``bitmap_construct_agg``; all bits of a key lie in one bitmap.
BLOCK_BITS = 32_768
BITS_PER_KEY = 16
# Bits set per key. Of keys that are not in the filter about 0.3 % pass.
PROBES = 4


def _block(columns: list[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(blocks))


def _places(columns: list[str]) -> list[Column]:
    """Places of a key's bits in its bitmap, from a hash that its bitmap does not depend on."""
    bits = F.xxhash64(F.lit("places"), *columns)
    width = BLOCK_BITS.bit_length() - 1
    return [F.shiftrightunsigned(bits, width * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]


def likely_members(rows: DataFrame, keys: DataFrame, columns: list[str], count: int) -> DataFrame:
    """``rows`` whose ``columns`` are probably among ``keys``; those that are among them all stay.

    The filter takes two bytes for each of the ``count`` keys and is broadcast, so the caller
    bounds ``count``. A null counts as a value.
    """
    blocks = max(1, math.ceil(count * BITS_PER_KEY / BLOCK_BITS))
    bitmaps = (
        keys.select(_block(columns, blocks).alias("_block"), F.explode(F.array(*_places(columns))).alias("_place"))
        .groupBy("_block")
        .agg(F.bitmap_construct_agg("_place").alias("_bits"))
    )
    found = rows.withColumn("_block", _block(columns, blocks)).join(F.broadcast(bitmaps), "_block")
    for place in _places(columns):
        byte = F.substr("_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))
        bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), place.bitwiseAND(F.lit(7)).cast("int"))
        found = found.filter(bit == 1)
    return found.drop("_block", "_bits")
