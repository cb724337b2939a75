"""Baseline KPIs: portfolio totals, channel mix, monthly trend, KYC mix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.functions.bits import key_bits, key_word
from riskmart.functions.numeric import average
from riskmart.operators import shared
from riskmart.operators.shared import period_change, share_of_total

MONTH = ["year_number", "month_number", "month_name", "quarter_name"]


def portfolio_summary(base: DataFrame, stats: DataFrame) -> DataFrame:
    """One row of totals over the whole fact.

    Distinct customers and accounts come with the totals from one scan: every row is
    dealt to the word of its customer and to that of its account, 64 keys a word, and
    words of set bits are merged before and after the one exchange. The totals ride on
    the customers' words. Transaction ids are text, so they are a subquery of their own.
    """
    ids = base.select("transaction_id").distinct().agg(F.count("transaction_id")).scalar()
    amount = F.when(F.col("whose") == 0, F.col("amount_usd"))
    keys = base.select("amount_usd", F.posexplode(
        F.array("customer_key", "account_key")).alias("whose", "key"))
    words = keys.groupBy("whose", key_word(F.col("key")).alias("word")).agg(
        key_bits(F.col("key")).alias("bits"),
        F.count(F.when(F.col("whose") == 0, 1)).alias("rows"), F.sum(amount).alias("volume"),
        F.count(amount).alias("amounts"), F.min(amount).alias("least"), F.max(amount).alias("most"))
    return words.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_transaction_lines"),
        *(F.coalesce(F.sum(F.when(F.col("whose") == place, F.bit_count("bits"))), F.lit(0))
          .cast("long").alias(name)
          for place, name in enumerate(("total_customers", "total_accounts"))),
        F.sum("volume").alias("total_volume_usd"),
        average(F.sum("volume"), F.coalesce(F.sum("amounts"), F.lit(0))).alias("avg_transaction_amount"),
        F.min("least").alias("min_transaction_amount"),
        F.max("most").alias("max_transaction_amount"),
    ).select(
        "total_transaction_lines", ids.alias("total_distinct_transactions"),
        "total_customers", "total_accounts",
        "total_volume_usd", "avg_transaction_amount",
        "min_transaction_amount", "max_transaction_amount",
        F.round(stats.select("std_dev_amount").scalar(), 2).alias("std_dev_amount"),
    )


def channel_mix(base: DataFrame) -> DataFrame:
    """Per channel: activity and its share of all transactions and volume."""
    return channel_mix_of(base.groupBy("channel").agg(*shared.totals()))


def channel_mix_of(groups: DataFrame) -> DataFrame:
    """The same from the totals of each channel."""
    mix = groups.select(
        "channel", F.col("rows").alias("transaction_count"), F.col("customers").alias("unique_customers"),
        F.col("volume").alias("total_volume_usd"),
        average(F.col("volume"), F.col("amounts")).alias("avg_transaction_amount"))
    mix = share_of_total(mix, "transaction_count", "transaction_pct")
    mix = share_of_total(mix, "total_volume_usd", "volume_pct")
    return mix.orderBy(F.desc("total_volume_usd"), "channel")


def monthly_trend(base: DataFrame, spine: DataFrame) -> DataFrame:
    """Per month: totals and the change of the volume against the month before.

    The calendar is broadcast: it has one row per day, whatever the fact holds.
    """
    months = base.join(F.broadcast(spine), "date_key").groupBy(*MONTH).agg(
        F.count("*").alias("total_transactions"),
        shared.customers().alias("active_customers"),
        shared.volume().alias("total_volume_usd"),
        shared.mean_amount().alias("avg_transaction_amount"),
    )
    return period_change(
        months, ["year_number", "month_number"], "total_volume_usd",
        "mom_volume_change", "mom_change_pct",
    ).orderBy("year_number", "month_number")


def kyc_distribution(customers: DataFrame, base: DataFrame) -> DataFrame:
    """Per KYC status: customers (with or without transactions) and their activity.

    The fact is reduced to one row per customer before it meets the dimension,
    so a very busy customer weighs no more in the join than a quiet one.
    """
    activity = base.groupBy("customer_key").agg(
        F.count("transaction_key").alias("transactions"),
        F.sum("amount_usd").alias("volume"),
        F.count("amount_usd").alias("amounts"),
    )
    groups = customers.select("customer_key", "kyc_status").join(
        activity, "customer_key", "left"
    ).groupBy("kyc_status").agg(
        F.count_distinct("customer_key").alias("customer_count"),
        F.coalesce(F.sum("transactions"), F.lit(0)).alias("transaction_count"),
        F.sum("volume").alias("total_volume_usd"),
        average(F.sum("volume"), F.sum("amounts")).alias("avg_transaction_amount"),
    )
    return share_of_total(groups, "customer_count", "pct_of_customers").orderBy(
        F.desc_nulls_last("total_volume_usd"), "kyc_status")
