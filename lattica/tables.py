"""Reading the input tables."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package, also where the driver found it by sys.path alone."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in (known := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, by any path that Spark can read."""
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
