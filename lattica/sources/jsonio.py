"""JSON: parsing into types and serialization with sorted keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parsed(column: str, schema: str) -> Column:
    return F.from_json(F.col(column), schema)


def serialized(column: Column) -> Column:
    return F.to_json(column)


def pretty(column: Column) -> Column:
    return F.to_json(column, {"pretty": "true"})


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
