"""Prepared statements and settings over Spark SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PLACES = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"[^"]*"|(\?)""")


class SessionError(ValueError):
    """An unknown statement or a wrong number of values."""


class Session:
    def __init__(self, spark: SparkSession):
        self.spark, self._prepared = spark, {}
        self._settings = {"autocommit": "true", "max_rows": "10000"}

    def prepare(self, name: str, sql: str) -> int:
        """Keep a statement; the number of its ? outside quotes."""
        n = sum(1 for m in _PLACES.finditer(sql) if m.group(1))
        self._prepared[name] = (sql, n)
        return n

    def execute(self, name: str, *values, **tables: DataFrame) -> DataFrame:
        if name not in self._prepared:
            raise SessionError(f"no statement {name}")
        sql, n = self._prepared[name]
        if len(values) != n:
            raise SessionError(f"{n} values are needed")
        for t, df in tables.items():
            df.createOrReplaceTempView(t)
        return self.spark.sql(sql, args=list(values)) if n else self.spark.sql(sql)

    def deallocate(self, name: str) -> None:
        if self._prepared.pop(name, None) is None:
            raise SessionError(f"no statement {name}")

    def set(self, key: str, value: str) -> None:
        self._settings[key] = value

    def get(self, key: str) -> str | None:
        return self._settings.get(key)

    def get_int(self, key: str) -> int | None:
        value = self._settings.get(key)
        return int(value) if value is not None and re.fullmatch(r"-?\d+", value) else None
