"""Time queries on a generated star in which one customer, merchant, channel and account
hold a third of the rows each. Prints one line of JSON.

    python bench_skewed.py ROWS FOLDER [QUERY ...]

The star is written below FOLDER once and read again by later calls. It takes about 35
bytes a row.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.queries import QUERIES, Inputs
from riskmart.sources import Star, read_star, write_star

HOT = 3  # every third row belongs to the hot keys, each by a hash of its own


def skewed_star(spark: SparkSession, rows: int) -> Star:
    """A star of ``rows`` transactions over 270 days; equal for equal ``rows``."""
    customers, merchants = max(30, rows // 60), max(25, min(20_000, rows // 100))

    def pick(name: str, n: int):
        h = F.xxhash64("id", F.lit(name))
        return F.when(F.pmod(h, F.lit(HOT)) == 0, 0).otherwise(F.pmod(F.shiftright(h, 8), F.lit(n)))

    def fact() -> DataFrame:
        second = F.pmod(F.xxhash64("id", F.lit("time")), F.lit(270 * 86400))
        moment = F.timestamp_add("SECOND", second.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
        day = F.col("transaction_date")
        flagged = F.pmod(F.xxhash64("id", F.lit("flag")), F.lit(10)) == 0
        return spark.range(rows).withColumns({
            "transaction_datetime": moment, "transaction_date": moment.cast("date"),
        }).select(
            F.col("id").alias("transaction_key"), F.concat(F.lit("T"), F.col("id")).alias("transaction_id"),
            pick("customer", customers).alias("customer_key"), pick("account", 2 * customers).alias("account_key"),
            pick("merchant", merchants).alias("merchant_key"), pick("location", 25).alias("location_key"),
            (F.year(day) * 10000 + F.month(day) * 100 + F.day(day)).alias("date_key"), day,
            "transaction_datetime", F.hour("transaction_datetime").alias("transaction_hour"),
            F.lit("Transfer").alias("transaction_type"),
            F.concat(F.lit("channel "), pick("channel", 5)).alias("channel"),
            (F.pmod(F.xxhash64("id", F.lit("cents")), F.lit(500_000)) / 100).alias("amount_usd"),
            flagged.alias("is_flagged"), F.hour("transaction_datetime").between(1, 4).alias("is_off_hours"),
            F.when(flagged, F.concat(F.lit("type "), pick("type", 6))).alias("fraud_type"))

    def dimension(n: int, **columns) -> DataFrame:
        return spark.range(n).select(*(c.alias(name) for name, c in columns.items()))

    key, name = F.col("id"), F.col("id").cast("string")
    days = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    tables = {
        "dim_customer": lambda: dimension(
            customers, customer_key=key, full_name=name, country=F.concat(F.lit("C"), key % 25),
            kyc_status=F.element_at(F.array(*map(F.lit, ("Verified", "Pending", "Expired"))), (key % 3 + 1).cast("int")),
            customer_segment=name, preferred_channel=name),
        "dim_account": lambda: dimension(
            2 * customers, account_key=key, account_id=name, account_type=name, account_status=name,
            current_balance=key),
        "dim_merchant": lambda: dimension(
            merchants, merchant_key=key, merchant_name=name, merchant_category=name, risk_rating=name,
            is_shell_merchant=key % 25 == 0, country=F.concat(F.lit("C"), key % 25)),
        "dim_location": lambda: dimension(
            25, location_key=key, country=F.concat(F.lit("C"), key), region=name, is_high_risk_country=key >= 15),
        "dim_date": lambda: dimension(
            270, date_key=F.year(days) * 10000 + F.month(days) * 100 + F.day(days), year_number=F.year(days),
            month_number=F.month(days), month_name=F.date_format(days, "MMM"),
            quarter_name=F.concat(F.lit("Q"), F.quarter(days)), day_of_week=F.date_format(days, "E"),
            is_weekend=F.weekday(days) >= 5),
        "fact_transactions": fact,
    }
    return Star(lambda table: tables[table]())


def main(rows: int, folder: str, names: list[str]) -> None:
    spark = (SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "64").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    path = f"{folder}/skewed-{rows}"
    if not os.path.isdir(path):
        write_star(skewed_star(spark, rows), path)
    seconds = {}
    for name in names:
        begun = time.perf_counter()
        QUERIES[name](Inputs(read_star(spark, path))).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 2)
    print(json.dumps({"rows": rows, "seconds": seconds}))


if __name__ == "__main__":
    main(int(sys.argv[1]), sys.argv[2], sys.argv[3:] or list(QUERIES))
