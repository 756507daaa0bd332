"""Cutting lineage through storage that every executor can reach.

``staged`` writes a DataFrame as Parquet below the folder named by
``spark.checkpoint.dir`` and reads it back.  The result survives the loss of
executors, keeps no lineage, and is columnar and compressed.  ``discard`` deletes
what is used up; what a result still reads goes when the driver exits.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one, on a local master only."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='lattica-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session may have ended before the interpreter does
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back; the files go at ``discard``, or when the driver exits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*done: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in done:
        _delete(df.sparkSession, df._staged_at)
