"""Global positions without a single-task window.

Rows are sorted by range partitions; the partitions' sizes, one number each, give every
partition its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.plans.durable import staged


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with each row's position from 1 in the order, computed on all partitions at once.

    The sorted rows are staged, as positions need their counts before the rows are numbered.
    Rows that tie get positions in no particular order; a number of their own parts them, so
    that a value of a third of all rows still spreads over ranges.
    """
    parted = df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*order, "_tie").drop("_tie")
    parted = staged(parted.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return parted.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + local).drop("_part", "_at", "_before")  # a row for each partition


def running_total(df: DataFrame, order: str, amount: str, name: str = "total") -> DataFrame:
    """``df``, whose ``order`` is unique, with the sum of ``amount`` up to each row, computed on all partitions at once."""
    parted = staged(df.orderBy(order).withColumn("_part", F.spark_partition_id()), "sorted")
    sums = parted.groupBy("_part").agg(F.sum(amount).alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    own = F.sum(amount).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return parted.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")  # a row for each partition
