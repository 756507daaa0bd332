"""The catalogue of queries: a name, a Spark function and, where SQL can say it, an oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Modules that register queries when imported.
MODULES = ("flagship", "q_scan", "q_join", "q_agg", "q_window", "q_text", "q_mutate", "q_more", "q_stream")

_found: dict[str, Query] = {}


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


def add(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    if name in _found:
        raise ValueError(f"query {name} is registered twice")
    _found[name] = Query(name, run, oracle)


def query(oracle: str | None = None, name: str | None = None):
    """Register the decorated function under its own name or ``name``."""

    def register(f):
        add(name or f.__name__, f, oracle)
        return f

    return register


def all_queries() -> list[Query]:
    for m in MODULES:
        importlib.import_module(f"lattica.plans.{m}")
    return list(_found.values())
