"""Portfolio statistics and summary kept up month by month.

Each month's sums are stored once, in a folder of its own; the figures of the whole are
merged from one row a month. A new or corrected month is read and replaced alone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.operators import report
from riskmart.operators.foundation import flagged_base, merged_stats, monthly_partials
from riskmart.sources import read_star

PARTIALS = "monthly_partials"
SUMS = ("rows", "volume", "amounts", "flagged", "flagged_volume")


def refresh(spark: SparkSession, star_path: str, path: str, months: Iterable[str] | None = None) -> DataFrame:
    """Store the sums of ``months`` (as "2024-01"; all, if None) below ``path``, each
    replacing what was there for it, and return the sums of all stored months.

    Only the folders of the named months are read. Rows without a date belong to no
    month: they count when all months are refreshed, and stay as they were otherwise.
    """
    folder = f"{path}/{PARTIALS}"

    def keep(partials: DataFrame) -> None:
        (partials.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("month").parquet(folder))

    if months is None:
        keep(monthly_partials(flagged_base(read_star(spark, star_path).fact)))
    for month in months or ():
        keep(monthly_partials(flagged_base(read_star(spark, star_path, (month, month)).fact)))
    return stored(spark, path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    schema = ("rows long, amounts long, volume decimal(28,2), spread double, flagged long,"
              " flagged_volume decimal(28,2), month string")
    return spark.read.schema(schema).parquet(f"{path}/{PARTIALS}")


def portfolio_stats(partials: DataFrame) -> DataFrame:
    return merged_stats(partials)


def exec_summary(partials: DataFrame) -> DataFrame:
    whole = partials.agg(*(F.sum(name).alias(name) for name in SUMS))
    return report.exec_summary_of(whole.withColumn("rows", F.coalesce("rows", F.lit(0))))
