"""FNV-1a over UTF-8 bytes, and shard numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
FNV_OFFSET, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295
SHARDS = {"c": 256, "g": 128, "s": 128, "grp": 64, "m": 128}


def fnv1a32(text) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a non-negative long."""
    digits = F.hex(F.encode(text, "UTF-8"))
    at = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, F.lit(FNV_OFFSET).cast("long"), lambda acc, i: (
        acc.bitwiseXOR(F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(MASK).cast("long")))


def shard_of(kind: str, key) -> Column:
    return (fnv1a32(key) % F.lit(SHARDS[kind])).cast("int")
