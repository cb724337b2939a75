"""Composite risk score: four behavioural signals, KYC status, tiers, percentiles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.functions.ladder import Rungs, ladder, matches
from riskmart.functions.numeric import average, count_percent, count_ratio, ratio, whole
from riskmart.functions.ranking import standings
from riskmart.operators.profiling import CUTOFF
from riskmart.operators.shared import share_of_total

# Fixed values: (lowest rate or multiplier, points), the points below the lowest
# rung, and the tiers by total score.
OFF_HOURS_POINTS: Rungs = ((40, 25), (25, 18), (10, 10))
OFF_HOURS_REST = 3
SPEND_POINTS: Rungs = ((10, 25), (5, 18), (2, 10))
SPEND_REST = 2
SPEND_UNKNOWN = 0
SHELL_POINTS: Rungs = ((50, 20), (25, 13), (10, 7))
SHELL_REST = 1
GEO_POINTS: Rungs = ((50, 20), (20, 13), (5, 6))
GEO_REST = 0
KYC_POINTS = (("Expired", 10), ("Pending", 5))
KYC_REST = 0
TIERS: Rungs = ((70, "CRITICAL"), (50, "HIGH"), (30, "MEDIUM"))
LOWEST_TIER = "LOW"

POINTS = ["score_off_hours", "score_spend_spike", "score_shell_merchant",
          "score_geo_risk", "score_kyc"]


def _off_hours_sums() -> list[Column]:
    return [F.count("*").alias("total_txns"),
            F.sum("is_off_hours_int").alias("off_hours_txns")]


def _spend_sums(cutoff: dt.date) -> list[Column]:
    early = F.col("transaction_date") < F.lit(cutoff)
    late = F.col("transaction_date") >= F.lit(cutoff)

    def period(name: str, condition: Column) -> list[Column]:
        amount = F.when(condition, F.col("amount_usd"))
        return [F.count(F.when(condition, 1)).alias(f"{name}_rows"),
                F.count(amount).alias(f"{name}_amounts"),
                F.sum(amount).alias(f"{name}_volume")]

    return period("early", early) + period("late", late)


def _match_sums(flag: str, matched: str, name: str) -> list[Column]:
    """Sums over groups of ``total_txns`` rows each."""
    return [F.coalesce(F.sum(F.when(F.col(matched), F.col("total_txns"))), F.lit(0))
            .alias(f"{name}_matched"),
            F.sum(F.col(flag).cast("long") * F.col("total_txns")).alias(f"{name}_rows")]


#: the counts and sums of ``_off_hours_sums`` and ``_spend_sums``; they add up over groups
ADDITIVE = ["total_txns", "off_hours_txns", "early_rows", "early_amounts", "early_volume",
            "late_rows", "late_amounts", "late_volume"]


def _off_hours_rate() -> Column:
    return count_percent(
        F.col("off_hours_txns"), F.col("total_txns")).alias("off_hours_rate_pct")


def _enough(min_each: int) -> Column:
    return (F.col("early_rows") >= min_each) & (F.col("late_rows") >= min_each)


def _spend_multiplier() -> Column:
    """Late mean over early mean, both unrounded: one quotient of cross products."""
    late = F.col("late_volume") * whole(F.col("early_amounts"))
    early = F.col("early_volume") * whole(F.col("late_amounts"))
    return ratio(late, early, 2)


def _match_rate(name: str, alias: str) -> Column:
    return count_percent(F.col(f"{name}_rows"), F.col(f"{name}_matched")).alias(alias)


def _shell_flags(merchants: DataFrame) -> DataFrame:
    return merchants.select(
        "merchant_key", "is_shell_merchant", F.lit(True).alias("merchant_known"))


def _risk_flags(locations: DataFrame) -> DataFrame:
    return locations.select(
        "location_key", "is_high_risk_country", F.lit(True).alias("location_known"))


def off_hours_signal(base: DataFrame) -> DataFrame:
    """Per customer: transactions, off-hours transactions and their rate."""
    return base.groupBy("customer_key").agg(*_off_hours_sums()).select(
        "customer_key", "total_txns", "off_hours_txns", _off_hours_rate())


def spend_spike_signal(
    base: DataFrame, cutoff: dt.date = CUTOFF, min_each: int = 3
) -> DataFrame:
    """Per customer with enough rows on both sides of ``cutoff``: means and multiplier."""
    return base.groupBy("customer_key").agg(*_spend_sums(cutoff)).filter(
        _enough(min_each)
    ).select(
        "customer_key",
        average(F.col("early_volume"), F.col("early_amounts")).alias("early_avg_spend"),
        average(F.col("late_volume"), F.col("late_amounts")).alias("late_avg_spend"),
        _spend_multiplier().alias("spend_multiplier"),
    )


def shell_signal(base: DataFrame, merchants: DataFrame) -> DataFrame:
    """Per customer: share of transactions with a known merchant that is a shell."""
    groups = base.filter(F.col("merchant_key").isNotNull()).groupBy(
        "customer_key", "merchant_key").agg(F.count("*").alias("total_txns"))
    return groups.join(_shell_flags(merchants), "merchant_key").groupBy("customer_key").agg(
        *_match_sums("is_shell_merchant", "merchant_known", "shell")
    ).select("customer_key", _match_rate("shell", "shell_rate_pct"))


def geo_signal(base: DataFrame, locations: DataFrame) -> DataFrame:
    """Per customer: share of transactions with a known location that is high-risk."""
    groups = base.filter(F.col("location_key").isNotNull()).groupBy(
        "customer_key", "location_key").agg(F.count("*").alias("total_txns"))
    return groups.join(_risk_flags(locations), "location_key").groupBy("customer_key").agg(
        *_match_sums("is_high_risk_country", "location_known", "geo")
    ).select("customer_key", _match_rate("geo", "high_risk_country_rate_pct"))


def signals(
    base: DataFrame, merchants: DataFrame, locations: DataFrame,
    cutoff: dt.date = CUTOFF, min_each: int = 3,
) -> DataFrame:
    """All four signals per customer in one pass over the fact.

    The fact is grouped by customer, merchant and location first, so the joins see
    groups, never single rows. The dimensions join from the left, so a group without
    merchant or location still counts for the other signals; a signal without any
    matched row is NULL.
    """
    groups = base.groupBy("customer_key", "merchant_key", "location_key").agg(
        *_off_hours_sums(), *_spend_sums(cutoff))
    return (
        groups.join(_shell_flags(merchants), "merchant_key", "left")
        .join(_risk_flags(locations), "location_key", "left")
        .groupBy("customer_key")
        .agg(*_match_sums("is_shell_merchant", "merchant_known", "shell"),
             *(F.sum(name).alias(name) for name in ADDITIVE),
             *_match_sums("is_high_risk_country", "location_known", "geo"))
        .select(
            "customer_key", _off_hours_rate(),
            F.when(_enough(min_each), _spend_multiplier()).alias("spend_multiplier"),
            _match_rate("shell", "shell_rate_pct"),
            _match_rate("geo", "high_risk_country_rate_pct"))
    )


def scorecard(
    customer_signals: DataFrame, customers: DataFrame,
    off_hours: Rungs = OFF_HOURS_POINTS, spend: Rungs = SPEND_POINTS,
    shell: Rungs = SHELL_POINTS, geo: Rungs = GEO_POINTS, kyc=KYC_POINTS,
) -> DataFrame:
    """Points per signal for every customer with transactions."""
    multiplier = F.col("spend_multiplier")
    return customer_signals.join(customers, "customer_key").select(
        "customer_key", "full_name", "country", "kyc_status", "customer_segment",
        "off_hours_rate_pct", "spend_multiplier", "shell_rate_pct",
        "high_risk_country_rate_pct",
        ladder(F.col("off_hours_rate_pct"), off_hours, OFF_HOURS_REST).alias("score_off_hours"),
        F.when(multiplier.isNull(), SPEND_UNKNOWN)
        .otherwise(ladder(multiplier, spend, SPEND_REST)).alias("score_spend_spike"),
        ladder(F.col("shell_rate_pct"), shell, SHELL_REST).alias("score_shell_merchant"),
        ladder(F.col("high_risk_country_rate_pct"), geo, GEO_REST).alias("score_geo_risk"),
        matches(F.col("kyc_status"), kyc, KYC_REST).alias("score_kyc"),
    )


def tiered(scored: DataFrame, tiers: Rungs = TIERS) -> DataFrame:
    """Total score and tier of every scored customer."""
    total = sum((F.col(points) for points in POINTS[1:]), F.col(POINTS[0]))
    return scored.withColumn("total_risk_score", total).withColumn(
        "risk_tier", ladder(F.col("total_risk_score"), tiers, LOWEST_TIER))


def watchlist(scored: DataFrame, tiers: Rungs = TIERS) -> DataFrame:
    """Total score, tier and percentile (share of customers with a lower score).

    Left unordered: the list is stored and summarised, and whoever reads it orders
    the part they read, which spares a global sort over all customers.
    """
    ranked = standings(tiered(scored, tiers), "total_risk_score")
    ahead, others = F.col("rows_ahead"), F.col("rows_total") - 1
    return ranked.withColumn(
        "risk_percentile", F.coalesce(count_ratio(ahead * 100, others, 1), F.lit(0))
    ).drop("rows_ahead", "rows_total")


def tier_summary(listed: DataFrame, tiers: Rungs = TIERS) -> DataFrame:
    """Customers and scores per tier, highest tier first.

    Reads a stored watchlist or, where there is none, ``tiered`` customers: the
    percentile plays no part here.
    """
    groups = listed.groupBy("risk_tier").agg(
        F.count("*").alias("customer_count"),
        count_ratio(F.sum("total_risk_score"), F.count("*"), 1).alias("avg_score"),
        F.min("total_risk_score").alias("min_score"),
        F.max("total_risk_score").alias("max_score"),
    )
    position = [(label, place) for place, (_, label) in enumerate(tiers)]
    return share_of_total(groups, "customer_count", "pct_of_customers").select(
        "risk_tier", "customer_count", "pct_of_customers",
        "avg_score", "min_score", "max_score",
    ).orderBy(matches(F.col("risk_tier"), position, len(position)))
