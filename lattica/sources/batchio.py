"""Columnar batch files, with validity kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.plans.durable import staged


def write(df: DataFrame, path: str, compression: str = "zstd") -> None:
    df.write.option("compression", compression).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def round_trip(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back."""
    return staged(df, name)
