"""Columns about vectors; all arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda within ``body`` uses it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def wide(v: Column) -> Column:
    return v.cast("array<double>")


def literal(v: list[float]) -> Column:
    return F.lit([float(x) for x in v]).cast("array<double>") if len(v) else F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(wide(a), wide(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(wide(a), lambda x: x * x)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(wide(a), wide(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column, floor: float = 1e-10) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def unit(a: Column, floor: float = 1e-10) -> Column:
    return let(F.greatest(norm(a), F.lit(floor)), lambda n: F.transform(wide(a), lambda x: x / n))


def distance(a: Column, b: Column, metric: str) -> Column:
    return l2(a, b) if metric == "l2" else 1 - cosine(a, b)
