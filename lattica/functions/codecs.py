"""Hex, base 64 and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_encode(b: Column) -> Column:
    return F.lower(F.hex(b.cast("binary")))


def hex_decode(s: Column) -> Column:
    """NULL for an odd length or other characters."""
    return F.when(s.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(s))


def base64_encode(b: Column) -> Column:
    return F.regexp_replace(F.base64(b.cast("binary")), r"\s", "")


def base64_decode(s: Column) -> Column:
    """Padding is required, white space is ignored; NULL if it is malformed."""
    bare = F.regexp_replace(s, r"\s", "")
    return F.when(bare.rlike("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.unbase64(bare))


def adler32(b: Column) -> Column:
    """Sums modulo 65521 over the bytes, folded inside the JVM."""
    raw = F.hex(b.cast("binary"))
    size = F.octet_length(b)
    spots = F.when(size > 0, F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    start = F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    step = lambda s, i: F.struct(((s["a"] + byte(i)) % 65521).alias("a"), ((s["b"] + s["a"] + byte(i)) % 65521).alias("b"))
    return F.aggregate(spots, start, step, lambda s: s["b"] * 65536 + s["a"])
