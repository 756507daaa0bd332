"""Joins that Spark has no single call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.functions.nulls import compare

KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti")


def equi_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], kind: str = "inner", hint: str | None = None) -> DataFrame:
    """By pairs of key columns; NULL keys match nothing."""
    if kind not in KINDS:
        raise ValueError(f"unknown join {kind!r}")
    right = right.hint(hint) if hint else right
    return left.join(right, [left[a] == right[b] for a, b in keys], kind)


def theta_join(left: DataFrame, right: DataFrame, a: str, op: str, b: str, kind: str = "inner") -> DataFrame:
    """By any comparison of a left and a right column."""
    return left.join(right, compare(op, left[a], right[b]), kind)


def adjacent_pairs(df: DataFrame, key: str, order: str, by: list[str] = ()) -> DataFrame:
    """Rows next to each other in the order, within ``by``, that have equal keys; NULL equals NULL.

    order, next_order and key of each pair.
    """
    w = W.partitionBy(*by).orderBy(order)
    nxt = df.select(*by, order, key, F.lead(order).over(w).alias(f"next_{order}"), F.lead(key).over(w).alias("_key"))
    return nxt.where(F.col(f"next_{order}").isNotNull() & F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def copartitioned(left: DataFrame, right: DataFrame, n: int, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with equal keys in equal partitions."""
    return left.repartition(n, F.col(a)), right.repartition(n, F.col(b))


def bloom_prefilter(probe: DataFrame, build: DataFrame, key: Column, build_key: Column, bits: int | None = None) -> DataFrame:
    """``probe`` without rows whose key is surely absent from ``build``: a bitmap of hashes goes to every task.

    It has sixteen bits for each row of ``build``, counted first, if not told otherwise, and 16 MB at most; beyond 134 million
    rows that lets too much through, and ``probe`` is returned as it is.
    """
    if bits is None:
        n = build.count()
        if n > 1 << 27:
            return probe
        bits = min(1 << 27, max(1 << 16, 1 << (16 * n - 1).bit_length()))
    build_bits = build.select(F.pmod(F.xxhash64(build_key), F.lit(bits)).alias("bit"))
    words = build_bits.groupBy(F.bitmap_bucket_number("bit").alias("word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))  # bits / 8 bytes at most
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    joined = probe.withColumn("_bit", bit).withColumn("_word", F.bitmap_bucket_number("_bit")).join(F.broadcast(words), F.col("_word") == F.col("word"))
    at = F.bitmap_bit_position("_bit")
    byte = F.conv(F.hex(F.substring("map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.where(F.expr("1") == F.call_function("getbit", byte, (at % 8).cast("int"))).select(probe.columns)
