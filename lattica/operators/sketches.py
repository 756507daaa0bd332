"""Approximate distinct counts, quantiles, heavy hitters, samples and set similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def approx_distinct(c: Column, precision: int = 12) -> Column:
    """HyperLogLog with 2 ** precision registers."""
    if not 4 <= precision <= 16:
        raise ValueError("precision is 4 to 16")
    return F.approx_count_distinct(c, 1.04 / 2 ** (precision / 2))


def merged_distinct(df: DataFrame, by: str, column: str) -> DataFrame:
    """The distinct count over all groups from the union of the groups' sketches."""
    groups = df.groupBy(by).agg(F.hll_sketch_agg(column, F.lit(14)).alias("sketch"))
    return groups.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def quantile(c: Column, q: float, accuracy: int = 10_000) -> Column:
    """The exact minimum and maximum at the ends, an approximate quantile between."""
    if q <= 0:
        return F.min(c)
    return F.max(c) if q >= 1 else F.percentile_approx(c, q, accuracy)


def reservoir(df: DataFrame, key: Column, k: int, seed: int = 42) -> DataFrame:
    """A uniform sample of k rows: those of the least hashes of the key."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(k)


def heavy_hitters(df: DataFrame, column: str, k: int) -> DataFrame:
    """value, n of the k most frequent; exact, as partial aggregation bounds what is shuffled."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("value")).limit(k)


def minhash(elements: Column, k: int = 64) -> Column:
    """Signature of an array's elements: the least hash under each of k seeds."""
    return F.transform(F.sequence(F.lit(1), F.lit(k)), lambda seed: F.array_min(F.transform(elements, lambda x: F.xxhash64(x, seed))))


def estimated_jaccard(a: Column, b: Column) -> Column:
    """Share of equal slots of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def jaccard(a: Column, b: Column) -> Column:
    """Exact; 1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))
