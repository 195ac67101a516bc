"""Helpers for expressions on arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often a lambda in the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def steps(n: int | Column) -> Column:
    """0 .. n-1; empty for n = 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def at(x: Column, i: Column | int) -> Column:
    """The element at a 0-based place."""
    return F.get(x, F.lit(i) if isinstance(i, int) else i)


def built(n: int | Column, f: Callable[[Column], Column]) -> Column:
    """[f(0), ..., f(n-1)]"""
    return F.transform(steps(n), f)


def checked(ok: Column, value: Column, message: str) -> Column:
    """``value``, or an error where ``ok`` does not hold (null counts as no)."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))
