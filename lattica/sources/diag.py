"""Diagnostics: summaries, zones, plans and partition balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame, name: str) -> DataFrame:
    """name, columns, rows."""
    return df.agg(F.lit(name).alias("name"), F.lit(len(df.columns)).cast("bigint").alias("columns"), F.count("*").alias("rows"))


def zones(df: DataFrame, by: str, column: str) -> DataFrame:
    """zone, lo, hi: the range of a column in every zone."""
    return df.groupBy(F.col(by).alias("zone")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))


def candidate(op: str, value: Column) -> Column:
    """Whether a zone can hold a row that compares so; ``!=`` never rules one out."""
    lo, hi = F.col("lo"), F.col("hi")
    return {"=": (lo <= value) & (value <= hi), "<": lo < value, "<=": lo <= value, ">": hi > value, ">=": hi >= value, "!=": F.lit(True)}[op]


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The text of a plan."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def balance(df: DataFrame, partitions: int, key: str) -> DataFrame:
    """partitions that hold rows, largest, mean and skew (largest by mean) after hashing by key."""
    sizes = df.repartition(partitions, key).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("partitions"), F.max("n").alias("largest"), F.avg("n").alias("mean"), (F.max("n") / F.avg("n")).alias("skew"))


def rendered(df: DataFrame, rows: int, width: int, vertical: bool = False) -> str:
    """The first rows as a framed table, cells cut to ``width``."""
    return df._jdf.showString(rows, width, vertical)
