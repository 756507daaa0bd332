"""Versioned rows: as-of reads, garbage collection, conflicts, log replay and page snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: End of a version that is still current.
INFINITE = 2**63 - 1


def visible(versions: DataFrame, at: int, writer: int | None = None) -> DataFrame:
    """Versions (row_id, value, begin_ts, end_ts, committed, deleted, writer) seen at a time, and the reader's own."""
    own = F.lit(False) if writer is None else (F.col("writer") == writer) & (F.col("end_ts") == INFINITE)
    seen = F.col("committed") & (F.col("begin_ts") <= at) & (F.col("end_ts") > at)
    return versions.where((seen | (own & ~F.col("committed"))) & ~F.col("deleted"))


def collected(versions: DataFrame, oldest: int) -> DataFrame:
    """What garbage collection keeps for readers from ``oldest`` on."""
    return versions.where(~F.col("committed") | (F.col("end_ts") == INFINITE) | (F.col("end_ts") >= oldest))


def conflicts(reads: DataFrame, versions: DataFrame) -> DataFrame:
    """txn, row_id of reads (txn, begin, row_id) that another writer's later version contradicts."""
    changed = versions.where("committed").select(F.col("row_id"), "begin_ts", "writer")
    return reads.join(changed, "row_id").where((F.col("begin_ts") > F.col("begin")) & (F.col("writer") != F.col("txn"))).select("txn", "row_id").distinct()


def replay(log: DataFrame) -> DataFrame:
    """row_id, value after the log (lsn, txn, type, row_id, value): the last put or delete of committed transactions."""
    committed = log.where("type = 'commit'").select("txn").distinct()
    writes = log.where("type IN ('put', 'delete')").join(committed, "txn", "left_semi")
    last = writes.groupBy("row_id").agg(F.max_by(F.struct("type", "value"), "lsn").alias("w"))
    return last.where("w.type = 'put'").select("row_id", F.col("w.value").alias("value"))


def snapshot(pages: DataFrame, version: int) -> DataFrame:
    """page, data: the newest version up to ``version``."""
    return pages.where(F.col("version") <= version).groupBy("page").agg(F.max_by("data", "version").alias("data"))


def snapshot_gc(pages: DataFrame, watermark: int) -> DataFrame:
    """The newest version up to the watermark and all later ones."""
    newest = pages.where(F.col("version") <= watermark).groupBy("page").agg(F.max("version").alias("_newest"))
    return pages.join(newest, "page", "left").where((F.col("version") > watermark) | (F.col("version") == F.col("_newest"))).drop("_newest")
