"""Consistency checks of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verify(df: DataFrame, unique: list[str] = (), not_null: list[str] = (), foreign: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """rule, violations: keys that repeat, NULLs, and references without a target."""
    named = lambda rule, found: found.agg(F.lit(rule).alias("rule"), F.count("*").alias("violations"))
    out = [named(f"unique {c}", df.groupBy(c).agg(F.count("*").alias("n")).where("n > 1")) for c in unique]
    out += [named(f"not null {c}", df.where(F.col(c).isNull())) for c in not_null]
    for c, (target, key) in (foreign or {}).items():
        out.append(named(f"foreign {c}", df.where(F.col(c).isNotNull()).join(target, df[c] == target[key], "left_anti")))
    return reduce(DataFrame.unionAll, out)
