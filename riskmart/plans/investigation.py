"""The whole investigation: every report, stored as Parquet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from riskmart.queries import LABELS, QUERIES, Inputs, label_totals
from riskmart.sources import Star

#: Results other reports read. They are written first and read back from storage,
#: so nothing depends on what an executor has cached.
SHARED = ("f2_portfolio_stats", "q5_1_watchlist", "q6_1_exec_summary")

#: Reports that come from one scan of the fact, by way of the totals of all their labels
BY_LABEL = frozenset({
    "q1_2_channel_mix", "q2_1_time_window", "q4_3_channel_risk", "q6_1_exec_summary",
    "q6_2_exposure_by_type"})

#: One result per report. The fact itself is not copied, and the unlimited lists
#: are left to those who ask for them.
REPORTS = tuple(
    name for name in QUERIES if name != "f1_flagged_base" and not name.endswith("_all"))


def run_all(
    spark: SparkSession, star: Star, path: str,
    names: Iterable[str] = REPORTS, mode: str = "errorifexists",
) -> dict[str, DataFrame]:
    """Write the named results below ``path`` and return them as read from there.

    Files keep no order: sort what you read by the columns you look at.
    """
    wanted = list(names)
    stored: dict[str, DataFrame] = {}
    if len(BY_LABEL.intersection(wanted)) > 1:
        label_totals(Inputs(star)).write.mode(mode).parquet(f"{path}/{LABELS}")
        stored[LABELS] = spark.read.parquet(f"{path}/{LABELS}")
    for name in sorted(wanted, key=lambda n: (n not in SHARED, wanted.index(n))):
        QUERIES[name](Inputs(star, stored)).write.mode(mode).parquet(f"{path}/{name}")
        stored[name] = spark.read.parquet(f"{path}/{name}")
    return {name: stored[name] for name in wanted}
