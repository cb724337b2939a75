"""Customer profiles: behaviour before and after a date, foreign activity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.functions.numeric import average, count_ratio, ratio
from riskmart.operators import shared
from riskmart.operators.shared import first_rows

# First day of the late period.
CUTOFF = dt.date(2024, 5, 1)

# Labels of the takeover check.
LIKELY_TAKEOVER = "HIGH RISK — Likely Takeover"
INVESTIGATE = "MEDIUM RISK — Investigate"
NORMAL = "Normal Behaviour"


def takeover_profile(
    base: DataFrame, locations: DataFrame, customers: DataFrame,
    cutoff: dt.date = CUTOFF, min_early: int = 3, min_late: int = 5,
    n: int | None = 100,
) -> DataFrame:
    """Spending and hours of each customer before and after ``cutoff``.

    One pass over the fact serves both periods. A late row counts only where its
    location is known; early rows need none. The fact is reduced to groups by customer
    and location, which then meet the locations.
    """
    places = locations.select(
        "location_key", F.col("country").alias("place"), F.lit(True).alias("is_known"))
    inside = {"early": F.col("transaction_date") < F.lit(cutoff),
              "late": F.col("transaction_date") >= F.lit(cutoff)}

    def sums(name: str, condition) -> list:
        amount = F.when(condition, F.col("amount_usd"))
        hour = F.when(condition, F.col("transaction_hour"))
        return [F.count(F.when(condition, F.lit(1))).alias(f"{name}_rows"),
                F.sum(amount).alias(f"{name}_volume"), F.count(amount).alias(f"{name}_amounts"),
                F.sum(hour).alias(f"{name}_hour_sum"), F.count(hour).alias(f"{name}_hours")]

    def period(name: str, counted) -> list:
        total = lambda part: F.sum(F.when(counted, F.col(f"{name}_{part}")))
        none = F.lit(0)
        return [
            average(total("volume"), F.coalesce(total("amounts"), none)).alias(f"{name}_avg_spend"),
            count_ratio(total("hour_sum"), F.coalesce(total("hours"), none), 1).alias(f"{name}_avg_hour"),
            F.coalesce(total("rows"), none).alias(f"{name}_txn_count")]

    groups = base.groupBy("customer_key", "location_key").agg(
        *sums("early", inside["early"]), *sums("late", inside["late"]))
    visited = F.when(F.col("is_known") & (F.col("late_rows") > 0), F.col("place"))
    profiles = (
        groups.join(places, "location_key", "left")
        .groupBy("customer_key")
        .agg(*period("early", F.lit(True)), *period("late", F.col("is_known")),
             F.count_distinct(visited).alias("distinct_countries_late"))
        .filter((F.col("early_txn_count") >= max(min_early, 1))
                & (F.col("late_txn_count") >= max(min_late, 1)))
    )
    spend, before = F.col("late_avg_spend"), F.col("early_avg_spend")
    growth = spend / F.nullif(before, F.lit(0))
    shift = F.abs(F.col("late_avg_hour") - F.col("early_avg_hour"))
    rows = profiles.join(customers, "customer_key").select(
        "customer_key", "full_name", F.col("country").alias("home_country"),
        "kyc_status", "customer_segment", "preferred_channel",
        "early_avg_spend", "late_avg_spend",
        ratio(spend, before, 1).alias("spend_multiplier"),
        "early_avg_hour", "late_avg_hour", shift.alias("hour_shift"),
        "early_txn_count", "late_txn_count", "distinct_countries_late",
        F.when((growth >= 5) & (shift >= 4), LIKELY_TAKEOVER)
        .when(growth >= 3, INVESTIGATE)
        .otherwise(NORMAL).alias("takeover_flag"),
    )
    return first_rows(
        rows, n, F.desc_nulls_last("spend_multiplier"), F.asc("customer_key"))


def geo_mismatch(
    base: DataFrame, customers: DataFrame, locations: DataFrame, min_count: int = 3
) -> DataFrame:
    """Customer and high-risk country pairs where the country is not the home.

    Rows are reduced to groups by customer and location, these to countries; the
    customer dimension then joins the counts, not the transactions.
    """
    places = locations.filter("is_high_risk_country").select(
        "location_key", F.col("country").alias("transaction_country"), "is_high_risk_country")
    groups = base.filter(F.col("location_key").isNotNull()).groupBy("customer_key", "location_key").agg(
        F.count("*").alias("rows"), shared.volume().alias("volume"),
        F.count("amount_usd").alias("amounts"),
        F.min("transaction_date").alias("first"), F.max("transaction_date").alias("last"))
    visits = (
        groups.join(places, "location_key")
        .groupBy("customer_key", "transaction_country", "is_high_risk_country")
        .agg(
            F.sum("rows").alias("foreign_transaction_count"),
            F.sum("volume").alias("foreign_volume_usd"),
            average(F.sum("volume"), F.sum("amounts")).alias("avg_foreign_txn_value"),
            F.min("first").alias("first_foreign_txn"),
            F.max("last").alias("last_foreign_txn"),
        )
        .filter(F.col("foreign_transaction_count") >= min_count)
    )
    homes = customers.select(
        "customer_key", "full_name", F.col("country").alias("registered_country"))
    return (
        visits.join(homes, "customer_key")
        .filter(F.col("transaction_country") != F.col("registered_country"))
        .select(
            "customer_key", "full_name", "registered_country", "transaction_country",
            "is_high_risk_country", "foreign_transaction_count", "foreign_volume_usd",
            "avg_foreign_txn_value", "first_foreign_txn", "last_foreign_txn")
        .orderBy(F.desc("foreign_volume_usd"), "customer_key", "transaction_country")
    )
