"""Executive report: exposure, trend, freeze list and key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.functions.numeric import average, count_percent, percent
from riskmart.operators import shared
from riskmart.operators.anomaly import time_window
from riskmart.operators.baseline import MONTH
from riskmart.operators.shared import first_rows, period_change, share_of_total

# Recommended actions and their thresholds in percent and US dollars.
FREEZE, FREEZE_RATE, FREEZE_EXPOSURE = "FREEZE IMMEDIATELY", 70, 50000
ESCALATE, ESCALATE_RATE, ESCALATE_EXPOSURE = "ESCALATE TO COMPLIANCE", 50, 25000
MONITOR, MONITOR_RATE = "ENHANCED MONITORING", 30
REVIEW = "FLAG FOR REVIEW"


def exec_summary(base: DataFrame) -> DataFrame:
    """One row: transactions, flagged rate, volume and flagged exposure."""
    return exec_summary_of(base.agg(*shared.totals()))


def exec_summary_of(whole: DataFrame) -> DataFrame:
    """The same from one row of totals."""
    return whole.select(
        F.col("rows").alias("total_transactions"), F.col("flagged").alias("flagged_transactions"),
        count_percent(F.col("flagged"), F.col("rows")).alias("fraud_rate_pct"),
        F.col("volume").alias("total_portfolio_volume_usd"),
        F.col("flagged_volume").alias("estimated_fraud_exposure_usd"),
        percent(F.col("flagged_volume"), F.col("volume")).alias("exposure_as_pct_of_portfolio"))


def exposure_by_type(base: DataFrame) -> DataFrame:
    """Flagged rows per fraud type and their share of the exposure."""
    return exposure_by_type_of(
        base.filter("is_flagged_int = 1").groupBy("fraud_type").agg(*shared.totals()))


def exposure_by_type_of(groups: DataFrame) -> DataFrame:
    """The same from the totals of the flagged rows of each type."""
    exposure = groups.select(
        "fraud_type", F.col("rows").alias("flagged_transactions"),
        F.col("customers").alias("customers_affected"), F.col("volume").alias("estimated_exposure_usd"),
        average(F.col("volume"), F.col("amounts")).alias("avg_flagged_txn_value"))
    return share_of_total(exposure, "estimated_exposure_usd", "pct_of_total_exposure").orderBy(
        F.desc("estimated_exposure_usd"), "fraud_type")


#: labels of the reports that ``shared.label_totals`` serves from one scan
def report_labels() -> dict[str, Column]:
    return {
        "channel": F.struct(F.col("channel").alias("label")),
        "time_window": F.struct(time_window().alias("label")),
        "fraud_type": F.when(F.col("is_flagged_int") == 1, F.struct(F.col("fraud_type").alias("label")))}


def fraud_trend(base: DataFrame, spine: DataFrame) -> DataFrame:
    """Flagged rows per month and the change against the month listed before."""
    months = base.filter("is_flagged_int = 1").join(
        F.broadcast(spine), "date_key"
    ).groupBy(*MONTH).agg(
        F.count("*").alias("flagged_transactions"),
        shared.customers().alias("unique_affected_customers"),
        shared.volume().alias("monthly_exposure_usd"),
    )
    return period_change(
        months, ["year_number", "month_number"], "monthly_exposure_usd",
        "mom_exposure_change_usd", "mom_change_pct",
    ).orderBy("year_number", "month_number").drop("year_number", "month_number")


def freeze_list(
    base: DataFrame, customers: DataFrame, accounts: DataFrame,
    min_flagged: int = 10, n: int | None = 25,
) -> DataFrame:
    """Accounts with many flagged transactions and the action to take on each.

    Rows are reduced to one per customer and account, and to those with enough
    flagged transactions, before the two large dimensions are joined.
    """
    exposed = base.groupBy("customer_key", "account_key").agg(
        F.count("*").alias("total_transactions"),
        shared.flagged().alias("flagged_transactions"),
        shared.flagged_rate().alias("flagged_rate_pct"),
        shared.flagged_volume().alias("flagged_exposure_usd"),
        F.max("transaction_date").alias("last_transaction_date"),
    ).filter(F.col("flagged_transactions") >= min_flagged)
    rate, exposure = F.col("flagged_rate_pct"), F.col("flagged_exposure_usd")
    rows = exposed.join(
        customers.select("customer_key", "full_name", "country", "kyc_status"), "customer_key"
    ).join(accounts, "account_key").withColumn(
        "recommended_action",
        F.when((rate >= FREEZE_RATE) & (exposure >= FREEZE_EXPOSURE), FREEZE)
        .when((rate >= ESCALATE_RATE) | (exposure >= ESCALATE_EXPOSURE), ESCALATE)
        .when(rate >= MONITOR_RATE, MONITOR)
        .otherwise(REVIEW))
    return first_rows(
        rows, n, F.desc("flagged_exposure_usd"), F.asc("account_key"), F.asc("customer_key")
    ).select(
        "account_id", "full_name", "country", "kyc_status", "account_type", "account_status",
        F.col("current_balance").alias("current_balance_usd"),
        "total_transactions", "flagged_transactions", "flagged_rate_pct",
        "flagged_exposure_usd", "last_transaction_date", "recommended_action")


def kpi_report(summary: DataFrame, base: DataFrame) -> DataFrame:
    """Six key figures as text, in a fixed order.

    The freeze count tests the exact rate of every account, without a minimum
    number of flagged rows.
    """

    def line(place: int, metric: str, value) -> object:
        return F.struct(F.lit(place).alias("place"), F.lit(metric).alias("metric"),
                        value.cast("string").alias("value"))

    def one(frame: DataFrame, place: int, metric: str, value) -> DataFrame:
        return frame.select(line(place, metric, value).alias("line")).select("line.*")

    totals = summary.select(F.inline(F.array(
        line(1, "TOTAL TRANSACTIONS REVIEWED", F.col("total_transactions")),
        line(2, "TOTAL FRAUD EXPOSURE (USD)", F.concat(F.lit("$"), F.format_number(
            F.round("estimated_fraud_exposure_usd", 0), 0))),
        line(3, "FRAUD RATE (%)", F.concat(F.col("fraud_rate_pct").cast("string"), F.lit("%"))),
    )))
    # one aggregate of a few dozen rows serves both the channel and the type
    flagged = base.filter("is_flagged_int = 1").groupBy("channel", "fraud_type").agg(
        F.count("*").alias("rows"), F.sum("amount_usd").alias("volume"))
    tops = flagged.groupingSets([["channel"], ["fraud_type"]], "channel", "fraud_type").agg(
        F.grouping("fraud_type").alias("by_channel"), F.sum("rows").alias("rows"),
        F.sum("volume").alias("volume"))
    best = Window.partitionBy("by_channel").orderBy(
        F.when(F.col("by_channel") == 1, F.col("rows").cast("decimal(38,2)"))
        .otherwise(F.col("volume").cast("decimal(38,2)")).desc_nulls_last(),
        F.coalesce("channel", "fraud_type"))
    leaders = tops.withColumn("place", F.row_number().over(best)).filter("place = 1").select(F.when(
        F.col("by_channel") == 1, line(4, "HIGHEST RISK CHANNEL", F.col("channel"))
    ).otherwise(line(5, "HIGHEST RISK FRAUD TYPE", F.col("fraud_type"))).alias("line")).select("line.*")
    accounts = base.groupBy("account_key").agg(
        F.count("*").alias("rows"), shared.flagged().alias("flagged"),
        shared.flagged_volume().alias("exposure"),
    ).filter(
        (F.col("flagged") * 100 >= F.col("rows") * FREEZE_RATE)
        & (F.col("exposure") >= FREEZE_EXPOSURE)
    ).agg(F.count("*").alias("size"))
    return (
        totals
        .unionByName(leaders)
        .unionByName(one(accounts, 6, "ACCOUNTS RECOMMENDED FOR FREEZE", F.col("size")))
        .orderBy("place").select("metric", "value")
    )
