"""Inputs the other operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.functions.numeric import average
from riskmart.operators import shared


def flagged_base(fact: DataFrame) -> DataFrame:
    """The fact with both flags as 0/1 integers.

    Not persisted: the casts cost nothing in a scan, and a query reads only the
    columns it names, which a cached copy of a large fact would not allow.
    """
    return fact.withColumns({
        "is_flagged_int": F.col("is_flagged").cast("int"),
        "is_off_hours_int": F.col("is_off_hours").cast("int"),
    })


def portfolio_stats(fact: DataFrame) -> DataFrame:
    """One row: row count, mean and sample deviation of the amount, flagged rows."""
    return fact.agg(
        F.count("*").alias("total_rows"),
        average(F.sum("amount_usd"), F.count("amount_usd"), 6).alias("mean_amount"),
        F.stddev_samp("amount_usd").alias("std_dev_amount"),
        F.sum(F.col("is_flagged").cast("int")).alias("total_flagged"),
    )


def monthly_partials(base: DataFrame) -> DataFrame:
    """Per month of the transaction date: sums that merge into the portfolio statistics
    and the executive summary. ``spread`` is the sum of squared distances from the
    month's own mean, which loses no digits to a large common mean."""
    return base.groupBy(F.date_format("transaction_date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("rows"), F.count("amount_usd").alias("amounts"),
        F.sum("amount_usd").alias("volume"),
        (F.var_pop("amount_usd") * F.count("amount_usd")).alias("spread"),
        shared.flagged().alias("flagged"), shared.flagged_volume().alias("flagged_volume"))


def merged_stats(partials: DataFrame) -> DataFrame:
    """``portfolio_stats`` of the months together: their spreads, and the squared distances
    of their means from the common mean for each of their amounts."""
    whole = partials.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("amounts"), F.lit(0)).alias("n"), F.sum("volume").alias("sum"),
        F.sum("flagged").alias("total_flagged"), F.collect_list(
            F.struct("amounts", F.col("volume").cast("double").alias("volume"), "spread")).alias("months"))
    common = F.col("sum").cast("double") / F.nullif(F.col("n"), F.lit(0))
    squares = F.aggregate(
        F.filter("months", lambda m: m["amounts"] > 0), F.lit(0.0), lambda total, m: total + m["spread"]
        + m["amounts"] * (m["volume"] / m["amounts"] - common) * (m["volume"] / m["amounts"] - common))
    return whole.select(
        "total_rows", average(F.col("sum"), F.col("n"), 6).alias("mean_amount"),
        F.when(F.col("n") > 1, F.sqrt(squares / (F.col("n") - 1))).alias("std_dev_amount"),
        "total_flagged")


def date_spine(dim_date: DataFrame) -> DataFrame:
    """The calendar attributes the reports group by."""
    return dim_date.select(
        "date_key", "year_number", "month_number", "month_name",
        "quarter_name", "day_of_week", "is_weekend")
