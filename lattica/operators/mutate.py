"""Mutations as functions from DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.nulls import truthy


class MutationError(ValueError):
    """A mutation that the table does not allow."""


def insert(df: DataFrame, rows: list[tuple], columns: list[str] | None = None, id_col: str | None = None) -> DataFrame:
    """``df`` with the rows; columns that are not named are NULL.

    With ``id_col``, an id that is NULL or not positive becomes the next free one, and one that is taken
    is an error.  Only the largest id and the taken ones among the new come to the driver.
    """
    names = columns or df.columns
    if any(len(r) != len(names) for r in rows):
        raise MutationError("a row has another number of values than columns")
    made = [dict(zip(names, r, strict=True)) for r in rows]
    if id_col:
        nxt = (df.agg(F.max(id_col)).first()[0] or 0) + 1
        own: set[int] = set()
        for row in made:
            if row.get(id_col) is None or row[id_col] <= 0:
                row[id_col] = nxt
            if row[id_col] in own:
                raise MutationError(f"id {row[id_col]} is taken")
            own.add(row[id_col])
            nxt = max(nxt, row[id_col] + 1)
        if not df.where(F.col(id_col).isin(*own)).isEmpty():
            raise MutationError("an id is taken")
    return df.unionByName(df.sparkSession.createDataFrame([tuple(row.get(c) for c in df.columns) for row in made], df.schema))


def update(df: DataFrame, assignments: dict[str, Column], condition: Column) -> DataFrame:
    """New values are computed from the old row; a NULL condition leaves it."""
    hit = truthy(condition)
    return df.select(*(F.when(hit, assignments[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in assignments else F.col(c) for c in df.columns))


def delete(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~truthy(condition))


def compacted(df: DataFrame, partitions: int) -> DataFrame:
    """The same rows in fewer, even partitions."""
    return df.repartition(partitions)
