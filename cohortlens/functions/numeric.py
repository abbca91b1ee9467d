"""Numeric column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A lambda of a higher-order function evaluates what it captures again for
    every element; bound this way the captured value is a variable.
    """
    return F.transform(F.array(value), body)[0]


def round_even(value: Column, digits: int) -> Column:
    """Round half to even on the scaled double, the rule of array libraries."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient where an empty denominator gives 0 instead of an error."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        F.try_divide(numerator.cast("double"), denominator.cast("double"))
    )


def safe_double(value: Column, default: float = 0.0) -> Column:
    """Non-numeric, null, NaN and infinite values become ``default``."""
    number = value.try_cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(number)

