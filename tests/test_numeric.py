"""Exact ratios, ladders and minute numbers."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskmart.functions.calendar import minute_number
from riskmart.functions.ladder import ladder
from riskmart.functions.numeric import average, count_percent, count_ratio, ratio

RELAXED = settings(max_examples=8, deadline=None,
                   suppress_health_check=[HealthCheck.function_scoped_fixture])


def half_up(num, den, places):
    if den == 0:
        return None
    scaled = Fraction(num) / Fraction(den) * 10 ** places
    units = (2 * abs(scaled.numerator) + scaled.denominator) // (2 * scaled.denominator)
    return Decimal(units if scaled >= 0 else -units).scaleb(-places)


@RELAXED
@given(st.lists(st.tuples(
    st.decimals(-10 ** 9, 10 ** 9, places=2), st.integers(0, 10 ** 6)), min_size=1, max_size=30))
def test_ratio_of_money_is_exact(spark, pairs):
    rows = spark.createDataFrame(pairs, "num decimal(18,2), den long")
    found = rows.select("num", "den", average(F.col("num"), F.col("den")).alias("q")).collect()
    assert all(r.q == half_up(r.num, r.den, 2) for r in found)


@RELAXED
@given(st.lists(st.tuples(st.integers(0, 10 ** 12), st.integers(0, 10 ** 12)),
                min_size=1, max_size=30))
def test_percent_of_counts_is_exact(spark, pairs):
    rows = spark.createDataFrame(pairs, "num long, den long")
    found = rows.select("num", "den", count_percent(F.col("num"), F.col("den")).alias("q")).collect()
    assert all(r.q == half_up(100 * r.num, r.den, 2) for r in found)


@pytest.mark.parametrize("num, den, places, expected", [
    ("0.03", 2, 2, "0.02"), ("0.05", 2, 2, "0.03"), ("-0.05", 2, 2, "-0.03"),
    ("1.00", 0, 2, None), ("12.3449999996", 1, 2, "12.34"), ("1.00", 3, 6, "0.333333"),
])
def test_ratio_edges(spark, num, den, places, expected):
    row = spark.range(1).select(ratio(
        F.lit(Decimal(num)), F.lit(den).cast("decimal(20,0)"), places).alias("q")).first()
    assert row.q == (None if expected is None else Decimal(expected))


def test_a_quotient_beyond_a_long_does_not_wrap(spark):
    row = spark.range(1).select(
        ratio(F.lit(Decimal("9999999999999999.99")), F.lit(Decimal("0.01")), 2).alias("q"),
        count_ratio(F.lit(10 ** 17), F.lit(3), 1).alias("r")).first()
    assert row.q == Decimal("999999999999999999.00")
    assert row.r == Decimal("33333333333333333.3")


def test_sums_beyond_double_precision_stay_exact(spark):
    big = Decimal("9999999999999999.99")
    row = spark.range(1000).select(F.lit(big).cast("decimal(18,2)").alias("a")).agg(
        F.sum("a").alias("total"), average(F.sum("a"), F.count("a")).alias("mean")).first()
    assert row.total == big * 1000
    assert row["mean"] == big


@pytest.mark.parametrize("first, second, minutes", [
    ("2024-01-01 00:00:59", "2024-01-01 00:01:01", 1),
    ("2024-01-01 10:00:00", "2024-01-01 11:00:59", 60),
    ("2024-01-01 10:00:00", "2024-01-01 11:01:00", 61),
    ("2023-12-31 23:50:00", "2024-01-01 00:10:00", 20),
    ("1969-12-31 23:59:30", "1970-01-01 00:00:10", 1),
])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_minute_number_counts_boundaries(spark, first, second, minutes, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame(
            [(dt.datetime.fromisoformat(first), dt.datetime.fromisoformat(second))],
            "a timestamp_ntz, b timestamp_ntz")
        row = rows.select((minute_number(F.col("b")) - minute_number(F.col("a"))).alias("m")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row.m == minutes


def test_ladder_edges(spark):
    rows = spark.createDataFrame(
        [(Decimal("39.99"),), (Decimal("40.00"),), (Decimal("9.99"),), (None,)],
        "rate decimal(22,2)")
    found = rows.select(ladder(F.col("rate"), ((40, 25), (25, 18), (10, 10)), 3).alias("p"))
    assert [r.p for r in found.collect()] == [18, 25, 3, 3]


def test_half_up_reference():
    assert half_up(Decimal("0.125"), 1, 2) == Decimal("0.125").quantize(
        Decimal("0.01"), ROUND_HALF_UP)
