"""The three regimes of NULL: script comparisons, three-valued and two-valued logic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("=", "==", "!=", "<>", "<", "<=", ">", ">=")


def compare(op: str, left: Column, right: Column) -> Column:
    """SQL comparison: NULL where an operand is."""
    made = {
        "=": left == right, "==": left == right, "!=": left != right, "<>": left != right,
        "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right,
    }
    if op not in made:
        raise ValueError(f"unknown comparison {op!r}")
    return made[op]


def script_compare(op: str, left: Column, right: Column) -> Column:
    """Comparison of scripts: never NULL; with a NULL operand only ``!=`` holds, even for two."""
    return F.coalesce(compare(op, left, right), F.lit(op in ("!=", "<>")))


def truthy(value: Column) -> Column:
    """Two-valued logic: NULL is false."""
    return F.coalesce(value, F.lit(False))


def and2(a: Column, b: Column) -> Column:
    return truthy(a) & truthy(b)


def or2(a: Column, b: Column) -> Column:
    return truthy(a) | truthy(b)


def not2(a: Column) -> Column:
    return ~truthy(a)
