"""Signals, points, tiers and percentiles."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskmart.operators import scoring
from riskmart.queries import QUERIES, Inputs
from stars import make_star

D = Decimal
CUSTOMER = "customer_key long, full_name string, country string, kyc_status string, " \
           "customer_segment string, preferred_channel string"
SIGNALS = "customer_key long, off_hours_rate_pct decimal(22,2), spend_multiplier decimal(22,2), " \
          "shell_rate_pct decimal(22,2), high_risk_country_rate_pct decimal(22,2)"


def row(day="01-01", amount="10.00", **more):
    return dict(transaction_datetime=dt.datetime.fromisoformat(f"2024-{day}"),
                amount_usd=amount, **more)


def result(spark, name, fact, **dimensions):
    return QUERIES[name](Inputs(make_star(spark, fact, **dimensions))).collect()


def points(spark, kyc="Verified", **signals):
    values = {"off": None, "spend": None, "shell": None, "geo": None, **signals}
    given = spark.createDataFrame(
        [(1, *(None if values[k] is None else D(values[k]) for k in ("off", "spend", "shell", "geo")))],
        SIGNALS)
    customers = spark.createDataFrame([(1, "n", "c", kyc, "s", "p")], CUSTOMER)
    return scoring.scorecard(given, customers).first()


@pytest.mark.parametrize("rate, expected", [
    ("40.00", 25), ("39.99", 18), ("25.00", 18), ("24.99", 10), ("10.00", 10), ("9.99", 3), (None, 3)])
def test_off_hours_points(spark, rate, expected):
    assert points(spark, off=rate).score_off_hours == expected


@pytest.mark.parametrize("multiplier, expected", [
    ("10.00", 25), ("9.99", 18), ("5.00", 18), ("4.99", 10), ("2.00", 10), ("1.99", 2),
    ("0.00", 2), (None, 0)])
def test_spend_points(spark, multiplier, expected):
    assert points(spark, spend=multiplier).score_spend_spike == expected


@pytest.mark.parametrize("rate, expected", [
    ("50.00", 20), ("49.99", 13), ("25.00", 13), ("24.99", 7), ("10.00", 7), ("9.99", 1), (None, 1)])
def test_shell_points(spark, rate, expected):
    assert points(spark, shell=rate).score_shell_merchant == expected


@pytest.mark.parametrize("rate, expected", [
    ("50.00", 20), ("49.99", 13), ("20.00", 13), ("19.99", 6), ("5.00", 6), ("4.99", 0), (None, 0)])
def test_geo_points(spark, rate, expected):
    assert points(spark, geo=rate).score_geo_risk == expected


@pytest.mark.parametrize("status, expected", [
    ("Expired", 10), ("Pending", 5), ("Verified", 0), ("expired", 0), (None, 0)])
def test_kyc_points(spark, status, expected):
    assert points(spark, kyc=status).score_kyc == expected


def scored(spark, totals):
    """Customers whose points add up to the given totals."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(totals)], "customer_key long, t int")
    return rows.select(
        "customer_key", *(F.lit("x").alias(c) for c in
                          ("full_name", "country", "kyc_status", "customer_segment")),
        F.col("t").alias("score_off_hours"),
        *(F.lit(0).alias(c) for c in scoring.POINTS[1:]))


@pytest.mark.parametrize("total, tier", [
    (100, "CRITICAL"), (70, "CRITICAL"), (69, "HIGH"), (50, "HIGH"), (49, "MEDIUM"),
    (30, "MEDIUM"), (29, "LOW"), (4, "LOW")])
def test_tiers(spark, total, tier):
    assert scoring.watchlist(scored(spark, [total])).first().risk_tier == tier


def test_percentile_equals_percent_rank(spark):
    totals = [(k * k) % 97 + 4 for k in range(500)]
    listed = scoring.watchlist(scored(spark, totals)).withColumn(
        "plain", F.percent_rank().over(Window.orderBy("total_risk_score")) * 100)
    rows = listed.collect()
    assert len(rows) == 500
    assert all(abs(float(r.risk_percentile) - r.plain) <= 0.0500001 for r in rows)
    assert {r.risk_percentile for r in rows if r.total_risk_score == max(totals)} == {
        max(r.risk_percentile for r in rows)}


def test_percentile_of_one_and_of_ties(spark):
    assert scoring.watchlist(scored(spark, [40])).first().risk_percentile == 0
    found = scoring.watchlist(scored(spark, [4, 4, 4, 9])).collect()
    assert sorted(r.risk_percentile for r in found) == [D("0.0")] * 3 + [D("100.0")]


def test_tier_summary_order_and_shares(spark):
    found = scoring.tier_summary(scoring.watchlist(scored(spark, [4, 75, 30, 55, 5, 8]))).collect()
    assert [r.risk_tier for r in found] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    low = found[-1]
    assert (low.customer_count, low.pct_of_customers, low.avg_score, low.min_score, low.max_score) == (
        3, D("50.00"), D("5.7"), 4, 8)


def test_multiplier_uses_unrounded_means(spark):
    fact = [row("04-30", a) for a in ("0.01", "0.01", "0.02")] + [
        row("05-01", a) for a in ("0.10", "0.10", "0.10")]
    signal, = result(spark, "s5_spend_spike_signal", fact)
    assert (signal.early_avg_spend, signal.late_avg_spend) == (D("0.01"), D("0.10"))
    assert signal.spend_multiplier == D("7.50")


def test_multiplier_needs_three_rows_on_both_sides(spark):
    fact = [row("04-30")] * 3 + [row("05-01")] * 3
    assert result(spark, "s5_spend_spike_signal", fact)[0].spend_multiplier == D("1.00")
    assert result(spark, "s5_spend_spike_signal", fact[1:]) == []
    assert result(spark, "s5_spend_spike_signal", fact[:-1]) == []
    assert result(spark, "s5_scored", fact[1:])[0].spend_multiplier is None
    free = [row("04-30", "0.00")] * 3 + [row("05-01")] * 3
    assert result(spark, "s5_scored", free)[0].score_spend_spike == 0


def test_rates_divide_by_matched_rows(spark):
    fact = [row(merchant_key=1, location_key=1), row(merchant_key=2, location_key=None),
            row(merchant_key=None, location_key=2), row(merchant_key=77, location_key=77)]
    dimensions = dict(
        merchant=[dict(merchant_key=1, is_shell_merchant=True), dict(merchant_key=2)],
        location=[dict(location_key=1, is_high_risk_country=True), dict(location_key=2)])
    assert result(spark, "s5_shell_signal", fact, **dimensions)[0].shell_rate_pct == D("50.00")
    assert result(spark, "s5_geo_signal", fact, **dimensions)[0].high_risk_country_rate_pct == D("50.00")
    found, = result(spark, "s5_scored", fact, **dimensions)
    assert (found.shell_rate_pct, found.high_risk_country_rate_pct) == (D("50.00"), D("50.00"))


def test_a_customer_without_matches_has_null_signals(spark):
    fact = [row(merchant_key=None, location_key=None)]
    assert result(spark, "s5_shell_signal", fact) == []
    found, = result(spark, "s5_scored", fact)
    assert (found.shell_rate_pct, found.high_risk_country_rate_pct) == (None, None)
    assert (found.score_shell_merchant, found.score_geo_risk) == (1, 0)


def test_unknown_and_idle_customers_are_not_scored(spark):
    fact = [row(customer_key=1), row(customer_key=2), row(customer_key=None)]
    found = result(spark, "q5_1_watchlist", fact,
                   customer=[dict(customer_key=1), dict(customer_key=3)])
    assert [r.customer_key for r in found] == [1]


def test_one_pass_equals_the_single_signals(spark):
    d = Inputs(make_star(
        spark,
        [row("04-1%d" % (k % 9), str(k), customer_key=k % 4, merchant_key=k % 3 or None,
             location_key=k % 5 or None, is_off_hours=k % 3 == 0) for k in range(60)]
        + [row("06-1%d" % (k % 9), str(7 * k), customer_key=k % 3, merchant_key=1) for k in range(40)],
        merchant=[dict(merchant_key=1, is_shell_merchant=True), dict(merchant_key=2)],
        location=[dict(location_key=k, is_high_risk_country=k > 2) for k in (1, 2, 3)]))
    together = scoring.signals(d.base, d.star.merchant, d.star.location)
    apart = (
        scoring.off_hours_signal(d.base)
        .join(scoring.spend_spike_signal(d.base), "customer_key", "left")
        .join(scoring.shell_signal(d.base, d.star.merchant), "customer_key", "left")
        .join(scoring.geo_signal(d.base, d.star.location), "customer_key", "left")
        .select(together.columns))
    assert sorted(together.collect()) == sorted(apart.collect())
