"""Exact, order-independent ratios of sums and counts.

Dividing decimals in one step rounds twice (once to the scale of the quotient,
once to the places asked for). Here the quotient is a whole number of steps of
10^-places, so halves are always rounded away from zero and no result depends on
the order in which partial sums arrived.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHOLE = "decimal(20,0)"


def whole(count: Column) -> Column:
    """A count as an exact decimal factor or summand."""
    return count.cast(_WHOLE)


def ratio(num: Column, den: Column, places: int) -> Column:
    """Quotient of two decimals, half away from zero; NULL for a zero divisor.

    The remainder is taken off before dividing, so the division is exact. (``div``
    would do for decimals too, but wraps silently beyond a long.)
    """
    doubled, twice = _halves(num, den, places)
    steps = (doubled - doubled % twice) / twice
    return _in_places(num, den, steps.cast("decimal(30,0)"), places)


def count_ratio(num: Column, den: Column, places: int) -> Column:
    """The same for two whole numbers, in long arithmetic, which is much faster."""
    doubled, twice = _halves(num, den, places)
    steps = F.call_function("div", doubled, twice)
    return _in_places(num, den, steps.cast(_WHOLE), places)


def _halves(num: Column, den: Column, places: int) -> tuple[Column, Column]:
    """Dividend and divisor whose whole quotient is the rounded one."""
    divisor = F.abs(F.nullif(den, F.lit(0)))
    return F.abs(num) * F.lit(2 * 10 ** places) + divisor, divisor * 2


def _in_places(num: Column, den: Column, steps: Column, places: int) -> Column:
    signed = F.when((num < 0) != (den < 0), -steps).otherwise(steps)
    step = F.lit(Decimal(1).scaleb(-places))
    return (signed * step).cast(f"decimal(22,{places})")


def average(total: Column, count: Column, places: int = 2) -> Column:
    """Mean of a summed decimal column."""
    return ratio(total, whole(count), places)


def percent(part: Column, total: Column) -> Column:
    """Share of ``part`` in ``total`` as a percentage with two places."""
    return ratio(part * 100, total, 2)


def count_percent(part: Column, total: Column) -> Column:
    """The same for two whole numbers."""
    return count_ratio(part * 100, total, 2)
