"""Aggregates whose edge cases differ from Spark's built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.ordering import with_position


def script_agg(df: DataFrame, column: str) -> DataFrame:
    """count, sum, min and max of a column: NULLs skipped, reals truncated in the sum."""
    c = F.col(column)
    return df.agg(F.count(c).alias("count"), F.sum(c.cast("bigint")).alias("sum"), F.min(c).alias("min"), F.max(c).alias("max"))


def exact_sum(c: Column, scale: int = 2) -> Column:
    """Sum that does not depend on the order of rows."""
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double")


def first_by(c: Column, *order: Column) -> Column:
    """First non-null value by the order."""
    return F.min_by(c, F.when(c.isNotNull(), F.struct(*order)))


def last_by(c: Column, *order: Column) -> Column:
    """Last non-null value by the order."""
    return F.max_by(c, F.when(c.isNotNull(), F.struct(*order)))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def var_pop(c: Column) -> Column:
    return _or_zero(F.var_pop(c))


def var_samp(c: Column) -> Column:
    return _or_zero(F.var_samp(c))


def stddev_pop(c: Column) -> Column:
    return _or_zero(F.stddev_pop(c))


def stddev_samp(c: Column) -> Column:
    return _or_zero(F.stddev_samp(c))


def skewness(c: Column) -> Column:
    return _or_zero(F.skewness(c))


def kurtosis(c: Column) -> Column:
    """Population excess."""
    return _or_zero(F.kurtosis(c))


def covar_pop(x: Column, y: Column) -> Column:
    return _or_zero(F.covar_pop(x, y))


def covar_samp(x: Column, y: Column) -> Column:
    return _or_zero(F.covar_samp(x, y))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's; 0 where a variance is 0."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, x)) * F.var_pop(F.when(both, y)))
    return _or_zero(F.try_divide(F.covar_pop(x, y), spread))


def group_bounds(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """For sorted input, each group's first and last position (from 1)."""
    placed = with_position(df, [*(F.col(k) for k in keys), *order], "_n")
    return placed.groupBy(*keys).agg(F.min("_n").alias("first"), F.max("_n").alias("last"))
