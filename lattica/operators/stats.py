"""Column statistics, histograms, quantiles and selectivity estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.ordering import running_total


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """count (NULLs included), null_count, distinct, min, max, sum, avg, var_pop, stddev_pop of a number column."""
    c = F.col(column)
    return df.agg(
        F.count("*").alias("count"),
        F.count_if(c.isNull()).alias("null_count"),
        F.countDistinct(c).alias("distinct"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.sum(c).alias("sum"),
        F.avg(c).alias("avg"),
        F.coalesce(F.var_pop(c), F.lit(0.0)).alias("var_pop"),
        F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias("stddev_pop"),
    )


def equi_width(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """bucket (from 0), lo, hi, n; empty buckets included, values at the upper end in the last."""
    x = F.col(column).cast("double")
    range_ = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).where("a IS NOT NULL")
    width = (F.col("b") - F.col("a")) / buckets
    at = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((x - F.col("a")) / F.nullif(width, F.lit(0.0))), F.lit(buckets - 1))).cast("bigint")
    found = df.where(x.isNotNull()).join(F.broadcast(range_)).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))  # one row
    every = range_.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))).alias("bucket"), "a", width.alias("w"))
    return every.join(found, "bucket", "left").select("bucket", (F.col("a") + F.col("bucket") * F.col("w")).alias("lo"), (F.col("a") + (F.col("bucket") + 1) * F.col("w")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def equi_depth(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """bucket, lo, hi, n, distinct: ceil(count / buckets) rows each in order of value, the last one short.

    Values are counted first, and only the counts are put in order; a value with more rows than a bucket has goes to several.
    """
    counts = running_total(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), "value", "n")
    total = counts.agg(F.max("total").alias("_total"))
    size = F.ceil(F.col("_total") / F.lit(float(buckets)))
    sized = counts.join(F.broadcast(total.select(size.alias("size"))))  # one row
    first, last = F.floor((F.col("total") - F.col("n")) / F.col("size")), F.floor((F.col("total") - 1) / F.col("size"))
    spread = sized.withColumn("bucket", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    share = F.least("total", (F.col("bucket") + 1) * F.col("size")) - F.greatest(F.col("total") - F.col("n"), F.col("bucket") * F.col("size"))
    return spread.groupBy("bucket").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum(share).cast("bigint").alias("n"), F.count("*").alias("distinct"))


def nearest_rank(df: DataFrame, column: str, q: float) -> DataFrame:
    """The value at index round((n - 1) q) of the sorted non-null values, halves up.

    Approximate quantiles bracket the value; rows below the bracket are counted, and only the values in it are put in order.
    """
    known = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    near = F.percentile_approx("value", [max(0.0, q - 0.01), min(1.0, q + 0.01)], 1000)
    bracket = known.agg(F.count("*").alias("_n"), near.alias("_near")).select(F.floor((F.col("_n") - 1) * F.lit(float(q)) + 0.5).alias("_index"), F.get("_near", F.lit(0)).alias("_lo"), F.get("_near", F.lit(1)).alias("_hi"))
    row = bracket.first()
    if row["_lo"] is None:
        return known.limit(0)
    below = known.where(F.col("value") < F.lit(row["_lo"])).count()
    inside = known.where(F.col("value").between(F.lit(row["_lo"]), F.lit(row["_hi"]))).groupBy("value").agg(F.count("*").alias("n"))
    at = running_total(inside, "value", "n").withColumn("total", F.col("total") + below)
    return at.where((F.col("total") > row["_index"]) & (F.col("total") - F.col("n") <= row["_index"])).select("value")


def most_frequent(df: DataFrame, column: str, k: int) -> DataFrame:
    """value, n of the k most frequent non-null values; ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def eq_selectivity(distinct: Column) -> Column:
    return F.when(distinct > 0, 1.0 / distinct).otherwise(F.lit(0.0))


def range_selectivity(lo: Column, hi: Column, below: Column) -> Column:
    """Share of a uniform column under a bound."""
    return F.when(hi <= lo, F.lit(1.0)).otherwise(F.least(F.greatest((below - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def profile(df: DataFrame) -> DataFrame:
    """One row for each column: rows, nulls, approximate distinct values (1.6 % standard error, at most the non-null rows)."""
    parts = []
    for c in df.columns:
        parts += [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.least(F.approx_count_distinct(c, 0.016), F.count(c)).alias(f"{c}__distinct")]
    one = df.agg(F.count("*").alias("_rows"), *parts)
    items = F.array(*(F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"{c}__nulls").alias("nulls"), F.col(f"{c}__distinct").alias("distinct")) for c in df.columns))
    return one.select(F.inline(items))
