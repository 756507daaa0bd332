"""Selectivity estimates of predicates and plan costs."""

from __future__ import annotations

import math

#: Fixed values of the model.
RANGE, BETWEEN, LIKE, IS_NULL, OTHER = 0.3333, 0.25, 0.2, 0.05, 0.5
IN_EACH, IN_MOST, UNKNOWN_ROWS, IO_WEIGHT = 0.1, 0.9, 1000, 4


def eq(distinct: float) -> float:
    return 1 / max(distinct, 1)


def in_list(n: int) -> float:
    return min(IN_EACH * n, IN_MOST)


def both(a: float, b: float) -> float:
    return a * b


def either(a: float, b: float) -> float:
    return a + b - a * b


def negated(a: float) -> float:
    return 1 - a


def groups(rows: float) -> float:
    return math.sqrt(rows)


def join_rows(left: float, right: float, equi: bool = True) -> float:
    return left * right * (1 / max(left, right, 1) if equi else RANGE)


def sort_cost(rows: float) -> float:
    return rows * math.log2(max(rows, 2))
