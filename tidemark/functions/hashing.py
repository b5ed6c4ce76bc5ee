"""Hashes computed with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 32-bit FNV-1a offset basis and prime.
FNV_BASIS = 2166136261
FNV_PRIME = 16777619


def fnv1a_32(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as BIGINT."""

    def fold(items: Column, byte) -> Column:
        return F.aggregate(
            items,
            F.lit(FNV_BASIS).cast("bigint"),
            lambda h, x: (h.bitwiseXOR(byte(x)) * FNV_PRIME).bitwiseAND(0xFFFFFFFF),
        )

    # Plain ASCII is read character by character, anything else as pairs of hex digits.
    plain = fold(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    digits = F.hex(F.encode(text, "utf-8"))
    pairs = F.filter(F.split(digits, "(?<=\\G..)"), lambda p: p != "")
    other = fold(pairs, lambda p: F.conv(p, 16, 10).cast("bigint"))
    return (
        F.when(F.length(text) == 0, F.lit(FNV_BASIS).cast("bigint"))
        .when(F.octet_length(text) == F.length(text), plain)
        .otherwise(other)
    )


def unit_interval(key: Column, salt: str = "") -> Column:
    """A repeatable number in [0, 1) per key."""
    return F.crc32(F.concat(key.cast("string"), F.lit(salt)).cast("binary")) / F.lit(4294967296.0)
