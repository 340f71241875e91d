"""A blocked Bloom filter as a table of blocks, built and probed with DataFrame functions.

A key falls into one block of eight 64-bit words and sets one bit in each word, so that a probe reads one row. The table
has at most ``blocks`` rows of nine longs: with the default 65,536 blocks under 5 MB whatever the number of keys, which
is why it may be broadcast. More keys raise the rate of false positives only; callers confirm hits by an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 1 << 16
_WORDS = 8
_BLOCK = "_bloom_block"


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(F.lit("bits"), key)
    return [_one_bit(bits, i) for i in range(_WORDS)]


def _one_bit(bits: Column, i: int) -> Column:
    place = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def build(keys: DataFrame, column: str, blocks: int = BLOCKS) -> DataFrame:
    """The filter of the keys in a column; nulls are left out. Map-side combined, so a hot key costs nothing."""
    key = F.col(column)
    held = keys.where(key.isNotNull()).select(_block(key, blocks).alias(_BLOCK), *[m.alias(f"_m{i}") for i, m in enumerate(_masks(key))])
    return held.groupBy(_BLOCK).agg(*[F.bit_or(f"_m{i}").alias(f"_w{i}") for i in range(_WORDS)])


def flag_hits(df: DataFrame, column: str, held: DataFrame, flag: str, blocks: int = BLOCKS) -> DataFrame:
    """All rows with a boolean: false if the key is surely not in the filter (or null), true if it may be."""
    key = F.col(column)
    probe = df.withColumn(_BLOCK, F.when(key.isNotNull(), _block(key, blocks)))
    tests = [F.col(f"_w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(key))]
    hit = tests[0]
    for test in tests[1:]:
        hit = hit & test
    joined = probe.join(F.broadcast(held), _BLOCK, "left")
    return joined.select(*df.columns, F.coalesce(hit, F.lit(False)).alias(flag))
