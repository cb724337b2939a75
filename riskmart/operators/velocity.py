"""Rapid repeats of one customer, from counts per minute.

A gap counts minute boundaries, so it depends on the minutes two transactions
fall in and on nothing finer. Both checks therefore reduce the fact to one row
per customer and minute before they order anything. The number of those rows is
bounded by the calendar, however many transactions one customer has, and no pair
of transactions is ever formed.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.functions.calendar import minute_number
from riskmart.functions.numeric import count_ratio, ratio, whole
from riskmart.operators.shared import first_rows

OWNER = ["customer_key", "transaction_date"]


def rapid_gaps(
    base: DataFrame, customers: DataFrame, max_minutes: int = 60, min_count: int = 5,
    n: int | None = 50,
) -> DataFrame:
    """Customers who often transact within ``max_minutes`` of their previous transaction.

    Within a minute every row but the first follows at gap 0. The first row of a
    minute (by time, then key) follows the customer's previous minute.
    """
    minutes = (
        base.filter(F.col("transaction_datetime").isNotNull() & F.col("customer_key").isNotNull())
        .groupBy("customer_key", minute_number(F.col("transaction_datetime")).alias("minute"))
        .agg(
            F.count("*").alias("rows"),
            F.count("amount_usd").alias("amounts"),
            F.sum("amount_usd").alias("volume"),
            F.min_by(
                "amount_usd", F.struct("transaction_datetime", "transaction_key")
            ).alias("first_amount"),
        )
    )
    # ordered per customer: the calendar bounds these rows, not the transactions
    by_time = Window.partitionBy("customer_key").orderBy("minute")
    first_is_rapid = F.coalesce(F.col("gap") <= max_minutes, F.lit(False))
    rapid = (
        minutes.withColumn("gap", F.col("minute") - F.lag("minute").over(by_time))
        .withColumn("first_is_rapid", first_is_rapid)
        .groupBy("customer_key")
        .agg(
            F.sum(F.col("rows") - 1 + F.col("first_is_rapid").cast("int")).alias("rapid_txn_count"),
            F.min(F.when(F.col("rows") > 1, 0).when(F.col("first_is_rapid"), F.col("gap")))
            .alias("min_gap_minutes"),
            F.sum(F.when(F.col("first_is_rapid"), F.col("gap")).otherwise(0)).alias("gap_sum"),
            F.sum(
                F.when(F.col("first_is_rapid"), F.col("volume"))
                .when(F.col("amounts") > F.col("first_amount").isNotNull().cast("int"),
                      F.col("volume") - F.coalesce("first_amount", F.lit(0)))
            ).alias("rapid_window_volume_usd"),
        )
        .filter(F.col("rapid_txn_count") >= max(min_count, 1))
    )
    return _named(rapid, customers).select(
        "customer_key", "full_name", "country", "kyc_status",
        "rapid_txn_count", "min_gap_minutes",
        count_ratio(F.col("gap_sum"), F.col("rapid_txn_count"), 1).alias("avg_gap_minutes"),
        "rapid_window_volume_usd",
    ).transform(first_rows, n, F.desc("rapid_txn_count"), F.asc("customer_key"))


def rapid_pairs(
    base: DataFrame, customers: DataFrame, max_minutes: int = 60, min_pairs: int = 5,
    n: int | None = 50, ids_unique: bool = False,
) -> DataFrame:
    """Customers with many pairs of transactions on one date within ``max_minutes``.

    A pair is two rows of one customer and date with different ids, one strictly
    later than the other. Pairs are counted from the rows per minute; pairs that
    share an id are counted the same way within each repeated id and taken off.
    Where the id is a key of the table, ``ids_unique=True`` saves that second count.
    """
    rows = base.select(
        *OWNER, "transaction_id", "transaction_datetime",
        (F.col("amount_usd") * 100).cast("long").alias("cents"),
    )
    for compared in (*OWNER, "transaction_id", "transaction_datetime"):
        rows = rows.filter(F.col(compared).isNotNull())

    # One exchange by minute serves the instants, the minutes and the ids of a minute;
    # even a customer with a third of all rows is dealt out by its minutes.
    rows = rows.withColumn("minute", minute_number(F.col("transaction_datetime")))
    rows = rows.repartition(*OWNER, "minute")
    minutes = _per_minute(rows, OWNER)
    pairs = _pairs_between_ids(minutes, max_minutes)
    if not ids_unique:
        same_id = [*OWNER, "transaction_id"]
        taken_off = _pairs_per_minute(_per_minute(rows, same_id), same_id, max_minutes)
        pairs = pairs.unionByName(taken_off.select(
            "customer_key", *((-F.col(name).cast(WIDE)).alias(name) for name in SUMMED),
            F.lit(None).cast("long").alias("smallest_gap")))
    totals = pairs.groupBy("customer_key").agg(
        *(F.sum(name).alias(name) for name in SUMMED), F.min("smallest_gap").alias("min_gap_minutes"))

    rapid = totals.filter(F.col("pairs") >= max(min_pairs, 1))
    return _named(rapid, customers).select(
        "customer_key", "full_name", "country", "kyc_status",
        F.col("pairs").cast("long").alias("rapid_pair_count"), "min_gap_minutes",
        ratio(F.col("gaps"), F.col("pairs"), 1).alias("avg_gap_minutes"),
        # Half of the cents in dollars, by a product: the sum may exceed a long.
        F.when(F.col("priced_pairs") > 0,
               F.round(F.col("pair_cents") * F.lit(Decimal("0.005")), 2)).alias("approx_volume_usd"),
    ).transform(first_rows, n, F.desc("rapid_pair_count"), F.asc("customer_key"))


def _per_minute(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and minute: what is needed to count pairs of different instants.

    ``rows`` and ``cents`` are plain totals, ``priced`` the rows with an amount.
    Rows of one instant form no pair with each other; the ``tied_*`` columns hold
    their part of the products. Cents are whole numbers, so sums stay exact. A minute
    has an ``only_id`` if all its rows carry one.
    """
    instants = rows.groupBy(*keys, "minute", "transaction_datetime").agg(
        F.count("*").alias("rows"),
        F.count("cents").alias("priced"),
        F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"),
        F.min("transaction_id").alias("least_id"), F.max("transaction_id").alias("last_id"),
    )
    tied_cents = F.when(F.col("priced") > 1, F.col("cents") * whole(F.col("priced") - 1))
    return instants.groupBy(*keys, "minute").agg(
        F.sum("rows").alias("rows"),
        F.sum("priced").alias("priced"),
        F.sum("cents").alias("cents"),
        F.sum(F.col("rows") * F.col("rows")).alias("tied_rows"),
        F.sum(F.col("priced") * F.col("priced")).alias("tied_priced"),
        (F.sum("cents") + F.coalesce(F.sum(tied_cents), F.lit(0))).alias("tied_cents"),
        F.when(F.min("least_id") == F.max("last_id"), F.min("least_id")).alias("only_id"),
    )


def _pairs_per_minute(
    minutes: DataFrame, keys: list[str], max_minutes: int, *extra: Column
) -> DataFrame:
    """The pairs whose later row falls in each minute; minutes without pairs are left out."""
    by_time = Window.partitionBy(*keys).orderBy("minute")

    def before(value: Column) -> Column:
        if max_minutes < 1:
            return F.lit(0)
        earlier = by_time.rangeBetween(-max_minutes, -1)
        return F.coalesce(F.sum(value).over(earlier), F.lit(0))

    rows, priced, cents = F.col("rows"), F.col("priced"), F.col("cents")
    inside = F.call_function("div", rows * rows - F.col("tied_rows"), F.lit(2))
    priced_inside = F.call_function("div", priced * priced - F.col("tied_priced"), F.lit(2))
    return (
        minutes.select(
            "*", *extra,
            before(rows).alias("rows_before"),
            before(priced).alias("priced_before"),
            before(cents).alias("cents_before"),
            before(rows * F.col("minute")).alias("minutes_before"))
        .withColumn("pairs", inside + rows * F.col("rows_before"))
        .filter("pairs > 0")
        .withColumns({
            "pairs_inside": inside,
            "gaps": rows * (F.col("minute") * F.col("rows_before") - F.col("minutes_before")),
            "priced_pairs": priced_inside + priced * F.col("priced_before"),
            "pair_cents": cents * whole(priced) - F.col("tied_cents")
            + cents * whole(F.col("priced_before")) + F.col("cents_before") * whole(priced),
        })
    )


#: totals as decimals: a busy customer has more pairs than a long can hold gaps
SUMMED = ["pairs", "gaps", "pair_cents", "priced_pairs"]
WIDE = "decimal(38,0)"


def _pairs_between_ids(minutes: DataFrame, max_minutes: int) -> DataFrame:
    """Pair sums per minute over all ids, and the smallest gap between different ids.

    The closest pair of different ids lies within one minute or in two neighbouring
    minutes with rows, unless all rows of both carry one and the same id.
    """
    by_time = Window.partitionBy(*OWNER).orderBy("minute")
    pairs = _pairs_per_minute(
        minutes, OWNER, max_minutes,
        (F.col("minute") - F.lag("minute").over(by_time)).alias("gap"),
        F.lag("only_id").over(by_time).alias("only_id_before"))
    one_id = F.coalesce(F.col("only_id") == F.col("only_id_before"), F.lit(False))
    smallest = F.when(F.col("only_id").isNull() & (F.col("pairs_inside") > 0), F.lit(0)).when(
        (F.col("gap") <= max_minutes) & ~one_id, F.col("gap"))
    return pairs.select("customer_key", *(F.col(name).cast(WIDE).alias(name) for name in SUMMED),
                        smallest.cast("long").alias("smallest_gap"))


def _named(found: DataFrame, customers: DataFrame) -> DataFrame:
    return found.join(
        customers.select("customer_key", "full_name", "country", "kyc_status"), "customer_key")
