"""Window functions over a partition and an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec


def ordered(by: list[str], *order: Column | str) -> WindowSpec:
    return W.partitionBy(*by).orderBy(*order)


def running(by: list[str], *order: Column | str) -> WindowSpec:
    """From the partition's start to the current row."""
    return ordered(by, *order).rowsBetween(W.unboundedPreceding, W.currentRow)


def whole(by: list[str], *order: Column | str) -> WindowSpec:
    return ordered(by, *order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def running_sum(v: Column, w: WindowSpec) -> Column:
    """0 before the first known value."""
    return F.coalesce(F.sum(v).over(w), F.lit(0))


def running_avg(v: Column, w: WindowSpec) -> Column:
    return F.coalesce(F.avg(v).over(w), F.lit(0.0))


def nth_value(v: Column, k: int, w: WindowSpec) -> Column:
    if k < 1:
        raise ValueError("k counts from 1")
    return F.nth_value(v, k).over(w)


def dedup_adjacent(df: DataFrame, key: str, by: list[str], *order: str) -> DataFrame:
    """The first row of each run of equal keys."""
    w = ordered(by, *order)
    return df.withColumn("_p", F.lag(key).over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col("_p").eqNullSafe(F.col(key))).drop("_p", "_n")
