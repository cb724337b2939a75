"""Anomalies in time and amount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.functions.ladder import ladder
from riskmart.functions.numeric import average, ratio, whole
from riskmart.operators import shared
from riskmart.operators.shared import first_rows, share_of_total

# Label, first and last hour (both included); the rest is transition.
HOUR_BUCKETS = (
    ("Off-Hours (1AM-4AM)", 1, 4),
    ("Business Hours (8AM-6PM)", 8, 18),
)
OTHER_HOURS = "Transition Hours"

# Lowest ratio of the day to its rolling mean.
SPIKE_FLAGS = (("2.0", "SPIKE DETECTED"), ("1.5", "Elevated"))
NO_SPIKE = "Normal"


def time_window(buckets=HOUR_BUCKETS, otherwise: str = OTHER_HOURS) -> Column:
    """The bucket of the transaction hour; an unknown hour falls in the rest."""
    window = F
    for label, first, last in buckets:
        window = window.when(F.col("transaction_hour").between(first, last), F.lit(label))
    return window.otherwise(otherwise)


def time_of_day_profile(
    base: DataFrame, buckets=HOUR_BUCKETS, otherwise: str = OTHER_HOURS
) -> DataFrame:
    """Activity by bucket of the transaction hour."""
    return time_of_day_of(base.groupBy(
        time_window(buckets, otherwise).alias("time_window")).agg(*shared.totals()))


def time_of_day_of(groups: DataFrame) -> DataFrame:
    """The same from the totals of each bucket."""
    profile = groups.select(
        "time_window", F.col("rows").alias("total_transactions"),
        F.col("customers").alias("unique_customers"), F.col("volume").alias("total_volume_usd"),
        average(F.col("volume"), F.col("amounts")).alias("avg_transaction_amount"))
    return share_of_total(profile, "total_transactions", "pct_of_transactions").orderBy(
        F.desc_nulls_last("total_volume_usd"), "time_window")


def zscore_outliers(
    base: DataFrame, stats: DataFrame, customers: DataFrame, merchants: DataFrame,
    locations: DataFrame, threshold: float = 3, n: int | None = 100,
) -> DataFrame:
    """Transactions more than ``threshold`` deviations above the portfolio mean.

    Mean and deviation enter as subqueries, so the filter runs in the scan of the
    fact and only outliers reach the joins. The unrounded score is tested. Within
    one portfolio the amount orders rows exactly as the score does.
    """
    mean = stats.select("mean_amount").scalar()
    deviation = stats.select("std_dev_amount").scalar()
    score = (F.col("amount_usd") - mean).cast("double") / F.nullif(deviation, F.lit(0.0))
    # a plain bound, a little loose, that Parquet can compare; the exact test follows
    bound = stats.select((
        F.col("mean_amount").cast("double") + threshold * F.col("std_dev_amount")
        - 0.01 - 1e-9 * F.abs(F.col("mean_amount").cast("double") + threshold * F.col("std_dev_amount"))
    ).cast("decimal(18,2)")).scalar()
    outliers = base.filter((F.col("amount_usd") >= bound) & (score > threshold))
    rows = (
        outliers
        .join(customers.select("customer_key", "full_name"), "customer_key")
        .join(merchants.select(
            "merchant_key", "merchant_name", "merchant_category", "is_shell_merchant"),
            "merchant_key")
        .join(locations.select(
            "location_key", F.col("country").alias("transaction_country"),
            "is_high_risk_country"), "location_key")
        .select(
            "transaction_key", "transaction_id", "customer_key", "full_name",
            "transaction_datetime", "transaction_type", "channel", "amount_usd",
            F.round(mean, 2).alias("mean_amount"),
            F.round(deviation, 2).alias("std_dev_amount"),
            F.round(score.cast("decimal(30,12)"), 2).alias("z_score"),
            "merchant_name", "merchant_category", "is_shell_merchant",
            "transaction_country", "is_high_risk_country")
    )
    return first_rows(
        rows, n, F.desc("amount_usd"), F.asc("transaction_key")).drop("transaction_key")


def rolling_spikes(
    base: DataFrame, spine: DataFrame, window_rows: int = 7, flags=SPIKE_FLAGS
) -> DataFrame:
    """Daily volume against the mean of the last ``window_rows`` days with rows.

    The fact is reduced to days before the join, so what follows handles one row
    per calendar day. The flag looks at the rounded ratio.
    """
    days = base.groupBy("transaction_date", "date_key").agg(
        F.count("*").alias("transactions"), F.sum("amount_usd").alias("volume"))
    daily = days.join(spine, "date_key").groupBy(
        "transaction_date", "day_of_week", "is_weekend"
    ).agg(
        F.sum("transactions").alias("transaction_count"),
        F.sum("volume").alias("daily_volume_usd"),
    )
    frame = Window.orderBy(
        "transaction_date", "day_of_week", "is_weekend").rowsBetween(1 - window_rows, 0)
    volume = F.col("daily_volume_usd").cast("decimal(28,2)")
    return (
        daily
        .withColumn("rolling_sum", F.sum(volume).over(frame))
        .withColumn("rolling_days", whole(F.count(volume).over(frame)))
        .select(
            "transaction_date", "day_of_week", "is_weekend",
            "transaction_count", "daily_volume_usd",
            ratio(F.col("rolling_sum"), F.col("rolling_days"), 2).alias("rolling_7d_avg_usd"),
            ratio(volume * F.col("rolling_days"), F.col("rolling_sum"), 2).alias("spike_ratio"),
        )
        .withColumn("spike_flag", ladder(
            F.col("spike_ratio"),
            [(F.lit(cut).cast("decimal(22,2)"), label) for cut, label in flags], NO_SPIKE))
        .orderBy(F.desc_nulls_last("spike_ratio"), "transaction_date")
    )
