"""Event-time windows over a stream, an extension: tumbling, sliding and session windows with late data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans.durable import shared_dir


def source(spark: SparkSession, folder: str, pattern: str = "*.parquet", schema: str | None = None) -> DataFrame:
    """A stream of the Parquet files in ``folder`` whose names match."""
    kind = schema or spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(kind).option("pathGlobFilter", pattern).parquet(folder)


def tumbling(df: DataFrame, ts: str, size: str, late: str, by: list[str], slide: str | None = None) -> DataFrame:
    """start, by, n of each window; rows later than ``late`` are dropped."""
    w = F.window(ts, size, slide or size)
    counted = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w, *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")


def sessions(df: DataFrame, ts: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """start, end, by, n of each session: runs of rows with less than ``gap`` between."""
    counted = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def drained(df: DataFrame, name: str) -> DataFrame:
    """All that a finite stream yields: each batch's complete result replaces the last one in the shared folder."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/lattica-stream-{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    q = df.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")
