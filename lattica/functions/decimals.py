"""Decimal arithmetic with one rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("half_up", "half_even", "down")


def rescale(x: Column, scale: int, mode: str = "half_up") -> Column:
    if mode == "half_up":
        return F.round(x, scale)
    if mode == "half_even":
        return F.bround(x, scale)
    if mode == "down":
        return F.when(x < 0, F.ceil(x, F.lit(scale))).otherwise(F.floor(x, F.lit(scale)))
    raise ValueError(f"unknown mode {mode!r}")


def divide(a: Column, b: Column, scale: int, mode: str = "half_up") -> Column:
    """NULL for a zero divisor."""
    return rescale(F.try_divide(a.cast("decimal(20,6)"), b.cast("decimal(20,6)")), scale, mode)


def parse(s: Column, scale: int) -> Column:
    """Text with optional ``_`` between digits; NULL if it is no number."""
    return F.replace(s, F.lit("_"), F.lit("")).try_cast(f"decimal(38,{scale})")
