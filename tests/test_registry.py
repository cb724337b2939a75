"""What the driver finds."""

import inspect
import re

import __spark_entry__ as entry_point
from riskmart.plans.investigation import REPORTS, SHARED

KEYS = """
f1_flagged_base f2_portfolio_stats f3_date_spine
q1_1_portfolio_summary q1_2_channel_mix q1_3_monthly_trend q1_4_kyc_distribution
q2_1_time_window q2_2a_rapid_pairs q2_2b_rapid_gaps q2_3_zscore_outliers q2_4_daily_spikes
q3_1_account_takeover q3_2_geo_anomaly
q4_1_merchant_risk q4_2_shell_flows q4_3_channel_risk q4_4_country_exposure
s5_off_hours_signal s5_spend_spike_signal s5_shell_signal s5_geo_signal s5_scored
q5_1_watchlist q5_2_tier_summary
q6_1_exec_summary q6_2_exposure_by_type q6_3_fraud_trend q6_4_freeze_list q6_5_kpi_report
""".split()


def test_every_key_is_registered_with_an_oracle():
    assert len(KEYS) == 30
    def of_the_star(names):
        return {n for n in names if not re.match(r"op\d+_|pipeline$", n)}

    limited = {f"{name}_all" for name in KEYS} & set(entry_point.queries())
    assert of_the_star(entry_point.queries()) == set(KEYS) | limited
    assert of_the_star(entry_point.oracle_sql()) == set(KEYS) | limited
    assert len(limited) == 5


def test_queries_take_session_and_folder():
    for query in entry_point.queries().values():
        assert list(inspect.signature(query).parameters) == ["spark", "sf_dir"]


def test_the_stored_run_covers_every_report():
    assert set(REPORTS) == set(KEYS) - {"f1_flagged_base"}
    assert set(SHARED) <= set(REPORTS)
