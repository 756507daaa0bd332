"""Numeric and NULL-handling functions, and the registry by which new ones are added."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign(x: Column) -> Column:
    return F.signum(x).cast("bigint")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("bigint")


def floor(x: Column) -> Column:
    return F.floor(x).cast("bigint")


def round_half_away(x: Column, digits: int = 0) -> Column:
    """Half away from zero on the binary product with a power of ten."""
    scale = F.lit(float(10**digits))
    scaled = x.cast("double") * scale
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / scale


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def mod(a: Column, b: Column) -> Column:
    return F.try_mod(a.cast("bigint"), b.cast("bigint"))


def int_div(a: Column, b: Column) -> Column:
    """Truncating division of integers; NULL for a zero divisor."""
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint")))


def iif(c: Column, a: Column, b: Column) -> Column:
    """NULL for a NULL condition."""
    return F.when(c, a).when(~c, b)


def not_(x: Column, integer: bool = False) -> Column:
    return x == 0 if integer else ~x


def to_int(x: Column) -> Column:
    return x.try_cast("bigint")


def to_real(x: Column) -> Column:
    return x.try_cast("double")


def _both(a: Column, b: Column, made: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), made)


def min2(a: Column, b: Column) -> Column:
    return _both(a, b, F.least(a, b))


def max2(a: Column, b: Column) -> Column:
    return _both(a, b, F.greatest(a, b))


def clamp(v: Column, lo: Column, hi: Column) -> Column:
    """``hi`` where the bounds are crossed; NULL if any operand is."""
    return F.when(v.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.least(F.greatest(v, lo), hi))


def min_nulls_smallest(*xs: Column) -> Column:
    """Minimum in which NULL is the smallest value."""
    return F.when(sum((F.isnull(x).cast("int") for x in xs), F.lit(0)) == 0, F.least(*xs))


def max_nulls_smallest(*xs: Column) -> Column:
    """Maximum in which NULL is the smallest value: it skips NULLs."""
    return F.greatest(*xs)


@dataclass(frozen=True)
class Scalar:
    name: str
    least: int
    most: int
    make: Callable[..., Column]


class Registry:
    """Functions by name, whatever the case; unknown names and wrong arities give NULL."""

    def __init__(self):
        self._known: dict[str, Scalar] = {}
        for name, least, most, make in _BUILT_IN:
            self.register(Scalar(name, least, most, make))

    def register(self, f: Scalar) -> None:
        self._known[f.name.lower()] = f

    def names(self) -> list[str]:
        return sorted(self._known)

    def call(self, name: str, *args: Column) -> Column:
        f = self._known.get(name.lower())
        return f.make(*args) if f is not None and f.least <= len(args) <= f.most else F.lit(None)


def _or_only(make):
    return lambda *xs: xs[0] if len(xs) == 1 else make(*xs)


_BUILT_IN = (
    ("abs", 1, 1, F.abs), ("sign", 1, 1, sign), ("ceil", 1, 1, ceil), ("floor", 1, 1, floor),
    ("round", 1, 1, round_half_away), ("sqrt", 1, 1, sqrt), ("pow", 2, 2, F.pow), ("mod", 2, 2, mod),
    ("greatest", 1, 16, _or_only(F.greatest)), ("least", 1, 16, _or_only(F.least)), ("coalesce", 1, 16, F.coalesce),
    ("nullif", 2, 2, F.nullif), ("ifnull", 2, 2, F.ifnull), ("iif", 3, 3, iif), ("not", 1, 1, not_),
    ("to_int", 1, 1, to_int), ("to_real", 1, 1, to_real), ("is_null", 1, 1, F.isnull),
    ("min2", 2, 2, min2), ("max2", 2, 2, max2), ("clamp", 3, 3, clamp),
)
