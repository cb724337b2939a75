"""Building blocks the operators have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.functions.numeric import average, count_percent, percent


def volume() -> Column:
    return F.sum("amount_usd")


def mean_amount() -> Column:
    return average(F.sum("amount_usd"), F.count("amount_usd"))


def customers() -> Column:
    return F.count_distinct("customer_key")


def flagged() -> Column:
    return F.sum("is_flagged_int")


def flagged_rate() -> Column:
    return count_percent(flagged(), F.count("*"))


def flagged_volume() -> Column:
    return F.sum(F.when(F.col("is_flagged_int") == 1, F.col("amount_usd")).otherwise(F.lit(0)))


#: what the reports by one label are made of; those a report doesn't name cost nothing
def totals() -> list[Column]:
    return [F.count("*").alias("rows"), customers().alias("customers"),
            volume().alias("volume"), F.count("amount_usd").alias("amounts"),
            flagged().alias("flagged"), flagged_volume().alias("flagged_volume")]


def label_totals(base: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """``totals`` for the groups of several labels from one scan: ``kind`` (a key of
    ``labels``), ``label`` and the sums. A label is a struct of one field, ``label``, or
    NULL for rows outside its report.

    Every row goes into one group for each of its labels and its customer. These groups
    are merged before the exchange, so what is shuffled grows with the customers, and a
    distinct count is a count of groups.
    """
    named = F.array(*(F.struct(F.lit(kind).alias("kind"), label.alias("of"))
                      for kind, label in labels.items()))
    rows = base.select("customer_key", "amount_usd", "is_flagged_int", F.explode(named).alias("x"))
    rows = rows.filter(F.col("x.of").isNotNull())
    per_customer = rows.groupBy(
        F.col("x.kind").alias("kind"), F.col("x.of.label").alias("label"), "customer_key").agg(
        *totals()).drop("customers")
    return per_customer.groupBy("kind", "label").agg(
        F.count("customer_key").alias("customers"),
        *(F.sum(name).alias(name) for name in ("rows", "volume", "amounts", "flagged", "flagged_volume")))


def share_of_total(groups: DataFrame, measure: str, share: str) -> DataFrame:
    """Add what each group holds of the sum over all groups, in percent.

    ``groups`` is an aggregate by a label (channel, status, country, tier): the
    unpartitioned window sees one row per label, never the rows behind it.
    """
    value = F.col(measure).cast("decimal(28,2)")
    total = F.sum(value).over(Window.partitionBy())
    return groups.withColumn(share, percent(value, total))


def period_change(
    periods: DataFrame, order: list[str], measure: str, change: str, change_pct: str
) -> DataFrame:
    """Add the difference to the row before and that difference in percent.

    ``periods`` is an aggregate with one row per period, so the unpartitioned
    window sees as many rows as there are months.
    """
    previous = F.lag(measure).over(Window.orderBy(*order))
    return (
        periods.withColumn("previous_value", previous)
        .withColumn(change, F.col(measure) - F.col("previous_value"))
        .withColumn(change_pct, percent(F.col(change), F.col("previous_value")))
        .drop("previous_value")
    )


def first_rows(rows: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """The rows in order, cut to ``n`` unless that is None."""
    ordered = rows.orderBy(*order)
    return ordered if n is None else ordered.limit(n)
