"""Threshold ladders stated as data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (lowest value of the rung, result), highest rung first
Rungs = Sequence[tuple[object, object]]


def ladder(value: Column, rungs: Rungs, otherwise: object) -> Column:
    """Result of the first rung that ``value`` reaches; NULL reaches none."""
    chain = F
    for threshold, result in rungs:
        chain = chain.when(value >= F.lit(threshold), F.lit(result))
    return chain.otherwise(F.lit(otherwise))


def matches(value: Column, table: Sequence[tuple[str, object]], otherwise: object) -> Column:
    """Result stored for an exact label."""
    chain = F
    for label, result in table:
        chain = chain.when(value == F.lit(label), F.lit(result))
    return chain.otherwise(F.lit(otherwise))
