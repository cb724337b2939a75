"""Every operator as a query over a star, by the name it is registered under."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.operators import (
    anomaly, baseline, exposure, foundation, profiling, report, scoring, shared, velocity)
from riskmart.sources import Star


@dataclass(frozen=True)
class Inputs:
    """A star and what is derived from it for more than one query.

    Results found in ``stored`` (by query name) are used instead of being derived again.
    """

    star: Star
    stored: Mapping[str, DataFrame] = field(default_factory=dict)

    def _stored(self, name: str, derive: Callable[[], DataFrame]) -> DataFrame:
        return self.stored[name] if name in self.stored else derive()

    @cached_property
    def base(self) -> DataFrame:
        return foundation.flagged_base(self.star.fact)

    def groups(self, kind: str) -> DataFrame:
        """The stored totals by one label."""
        return self.stored[LABELS].filter(F.col("kind") == kind).withColumnRenamed("label", kind)

    @cached_property
    def spine(self) -> DataFrame:
        return foundation.date_spine(self.star.date)

    @cached_property
    def stats(self) -> DataFrame:
        return self._stored(
            "f2_portfolio_stats", lambda: foundation.portfolio_stats(self.star.fact))

    @cached_property
    def scored(self) -> DataFrame:
        signals = scoring.signals(self.base, self.star.merchant, self.star.location)
        return scoring.scorecard(signals, self.star.customer)

    @cached_property
    def watchlist(self) -> DataFrame:
        return self._stored("q5_1_watchlist", lambda: scoring.watchlist(self.scored))

    @cached_property
    def tiered(self) -> DataFrame:
        return self._stored("q5_1_watchlist", lambda: scoring.tiered(self.scored))

    @cached_property
    def summary(self) -> DataFrame:
        return self._stored("q6_1_exec_summary", lambda: _summary(self))


#: name under which ``Inputs.stored`` may hold the totals of several labels
LABELS = "label_totals"


def label_totals(d: Inputs) -> DataFrame:
    return shared.label_totals(d.base, report.report_labels())


def _by(kind: str, finish: Callable[[DataFrame], DataFrame], alone: Callable[[DataFrame], DataFrame]):
    """A report by one label, from stored totals or by itself."""
    return lambda d: finish(d.groups(kind)) if LABELS in d.stored else alone(d.base)


def _summary(d: Inputs) -> DataFrame:
    if LABELS not in d.stored:
        return report.exec_summary(d.base)
    # every row has one channel, NULL included
    sums = ("rows", "volume", "amounts", "flagged", "flagged_volume")
    whole = d.groups("channel").agg(*(F.sum(name).alias(name) for name in sums))
    return report.exec_summary_of(whole.withColumn("rows", F.coalesce("rows", F.lit(0))))


def _pairs(d: Inputs, **limits) -> DataFrame:
    return velocity.rapid_pairs(d.base, d.star.customer, **limits)


def _gaps(d: Inputs, **limits) -> DataFrame:
    return velocity.rapid_gaps(d.base, d.star.customer, **limits)


def _outliers(d: Inputs, **limits) -> DataFrame:
    return anomaly.zscore_outliers(
        d.base, d.stats, d.star.customer, d.star.merchant, d.star.location, **limits)


def _takeover(d: Inputs, **limits) -> DataFrame:
    return profiling.takeover_profile(d.base, d.star.location, d.star.customer, **limits)


def _freeze(d: Inputs, **limits) -> DataFrame:
    return report.freeze_list(d.base, d.star.customer, d.star.account, **limits)


#: ``*_all`` are the lists without their top-n limit.
QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    "f1_flagged_base": lambda d: d.base,
    "f2_portfolio_stats": lambda d: d.stats,
    "f3_date_spine": lambda d: d.spine,
    "q1_1_portfolio_summary": lambda d: baseline.portfolio_summary(d.base, d.stats),
    "q1_2_channel_mix": _by("channel", baseline.channel_mix_of, baseline.channel_mix),
    "q1_3_monthly_trend": lambda d: baseline.monthly_trend(d.base, d.spine),
    "q1_4_kyc_distribution": lambda d: baseline.kyc_distribution(d.star.customer, d.base),
    "q2_1_time_window": _by("time_window", anomaly.time_of_day_of, anomaly.time_of_day_profile),
    "q2_2a_rapid_pairs": _pairs,
    "q2_2a_rapid_pairs_all": lambda d: _pairs(d, n=None),
    "q2_2b_rapid_gaps": _gaps,
    "q2_2b_rapid_gaps_all": lambda d: _gaps(d, n=None),
    "q2_3_zscore_outliers": _outliers,
    "q2_3_zscore_outliers_all": lambda d: _outliers(d, n=None),
    "q2_4_daily_spikes": lambda d: anomaly.rolling_spikes(d.base, d.spine),
    "q3_1_account_takeover": _takeover,
    "q3_1_account_takeover_all": lambda d: _takeover(d, n=None),
    "q3_2_geo_anomaly": lambda d: profiling.geo_mismatch(
        d.base, d.star.customer, d.star.location),
    "q4_1_merchant_risk": lambda d: exposure.merchant_risk(d.base, d.star.merchant),
    "q4_2_shell_flows": lambda d: exposure.shell_flows(
        d.base, d.star.merchant, d.star.location),
    "q4_3_channel_risk": _by("channel", exposure.channel_risk_of, exposure.channel_risk),
    "q4_4_country_exposure": lambda d: exposure.country_exposure(d.base, d.star.location),
    "s5_off_hours_signal": lambda d: scoring.off_hours_signal(d.base),
    "s5_spend_spike_signal": lambda d: scoring.spend_spike_signal(d.base),
    "s5_shell_signal": lambda d: scoring.shell_signal(d.base, d.star.merchant),
    "s5_geo_signal": lambda d: scoring.geo_signal(d.base, d.star.location),
    "s5_scored": lambda d: d.scored,
    "q5_1_watchlist": lambda d: d.watchlist,
    "q5_2_tier_summary": lambda d: scoring.tier_summary(d.tiered),
    "q6_1_exec_summary": lambda d: d.summary,
    "q6_2_exposure_by_type": _by("fraud_type", report.exposure_by_type_of, report.exposure_by_type),
    "q6_3_fraud_trend": lambda d: report.fraud_trend(d.base, d.spine),
    "q6_4_freeze_list": _freeze,
    "q6_4_freeze_list_all": lambda d: _freeze(d, n=None),
    "q6_5_kpi_report": lambda d: report.kpi_report(d.summary, d.base),
}
