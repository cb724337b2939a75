"""Risk by merchant, channel and country."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.functions.numeric import average, count_percent, percent
from riskmart.functions.ranking import standings
from riskmart.operators import shared
from riskmart.operators.shared import share_of_total


def merchant_risk(base: DataFrame, merchants: DataFrame) -> DataFrame:
    """Activity, flagged rate and rank by flagged transactions of each merchant.

    The fact is grouped by the merchant key alone; names join the finished groups.
    """
    groups = base.groupBy("merchant_key").agg(
        F.count("*").alias("total_transactions"),
        shared.customers().alias("unique_customers"),
        shared.volume().alias("total_volume_usd"),
        shared.mean_amount().alias("avg_transaction_value"),
        shared.flagged().alias("flagged_count"),
        shared.flagged_rate().alias("flagged_rate_pct"),
    )
    named = groups.join(merchants, "merchant_key")
    return standings(named, "flagged_count", descending=True, few_values=False).select(
        "merchant_key", "merchant_name", "merchant_category", "risk_rating",
        "is_shell_merchant", F.col("country").alias("merchant_country"),
        "total_transactions", "unique_customers", "total_volume_usd",
        "avg_transaction_value", "flagged_count", "flagged_rate_pct",
        (F.col("rows_ahead") + 1).alias("risk_rank"),
    ).orderBy(F.desc_nulls_last("flagged_count"), "merchant_key")


def shell_flows(base: DataFrame, merchants: DataFrame, locations: DataFrame) -> DataFrame:
    """Flows through shell merchants by merchant, country of origin and channel."""
    shells = merchants.filter("is_shell_merchant").select(
        "merchant_key", "merchant_name", "merchant_category",
        F.col("country").alias("merchant_country"))
    origins = locations.select(
        "location_key", F.col("country").alias("transaction_origin_country"),
        "is_high_risk_country")
    keys = ["merchant_name", "merchant_category", "merchant_country",
            "transaction_origin_country", "is_high_risk_country", "channel"]
    # grouped by the fact's own keys before the joins, which see groups only
    groups = base.groupBy("merchant_key", "location_key", "channel", "customer_key").agg(
        F.count("*").alias("rows"), F.count("amount_usd").alias("amounts"),
        shared.volume().alias("volume"))
    return (
        groups.join(shells, "merchant_key").join(origins, "location_key")
        .groupBy(*keys)
        .agg(
            F.sum("rows").alias("transaction_count"),
            shared.customers().alias("unique_customers"),
            F.sum("volume").alias("total_volume_usd"),
            average(F.sum("volume"), F.sum("amounts")).alias("avg_transaction_value"),
        )
        .orderBy(F.desc("total_volume_usd"), *keys)
    )


def channel_risk(base: DataFrame) -> DataFrame:
    """Flagged transactions and flagged share of the volume of each channel."""
    return channel_risk_of(base.groupBy("channel").agg(*shared.totals()))


def channel_risk_of(groups: DataFrame) -> DataFrame:
    """The same from the totals of each channel."""
    return groups.select(
        "channel", F.col("rows").alias("total_transactions"), F.col("flagged").alias("flagged_count"),
        count_percent(F.col("flagged"), F.col("rows")).alias("flagged_rate_pct"),
        F.col("volume").alias("total_volume_usd"), F.col("flagged_volume").alias("flagged_volume_usd"),
        percent(F.col("flagged_volume"), F.col("volume")).alias("pct_volume_flagged"),
    ).orderBy(F.desc("flagged_rate_pct"), "channel")


def country_exposure(base: DataFrame, locations: DataFrame) -> DataFrame:
    """Activity, flagged rate and share of the volume of each country. Groups by location
    and customer meet the locations, not single rows."""
    places = locations.select("location_key", "country", "is_high_risk_country")
    visits = base.filter(F.col("location_key").isNotNull()).groupBy("location_key", "customer_key").agg(
        F.count("*").alias("rows"), shared.volume().alias("volume"), shared.flagged().alias("flagged"))
    groups = visits.join(places, "location_key").groupBy(
        "country", "is_high_risk_country"
    ).agg(
        F.sum("rows").alias("transaction_count"),
        shared.customers().alias("unique_customers"),
        F.sum("volume").alias("total_volume_usd"),
        F.sum("flagged").alias("flagged_count"),
        count_percent(F.sum("flagged"), F.sum("rows")).alias("flagged_rate_pct"),
    )
    return share_of_total(groups, "total_volume_usd", "pct_of_total_volume").orderBy(
        F.desc("flagged_count"), "country")
