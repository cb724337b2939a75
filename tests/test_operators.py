"""Edge rows of every operator outside velocity and scoring."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskmart.operators import anomaly, baseline, exposure, foundation, profiling, report
from riskmart.queries import QUERIES, Inputs
from stars import make_star

D = Decimal


def on(day, hour=12, **more):
    return dict(transaction_datetime=dt.datetime.fromisoformat(f"2024-{day}").replace(hour=hour), **more)


def inputs(spark, fact=(), **dimensions):
    return Inputs(make_star(spark, fact, **dimensions))


def result(spark, name, fact=(), **dimensions):
    return QUERIES[name](inputs(spark, fact, **dimensions)).collect()


# --- foundation and baseline ------------------------------------------------

def test_flags_become_integers(spark):
    rows = result(spark, "f1_flagged_base", [
        on("01-01", is_flagged=True, is_off_hours=False), on("01-01", is_flagged=None)])
    assert [(r.is_flagged_int, r.is_off_hours_int) for r in rows] == [(1, 0), (None, 0)]


def test_one_transaction_has_no_deviation(spark):
    stats, = result(spark, "f2_portfolio_stats", [on("01-01", amount_usd="5.00")])
    assert (stats.total_rows, stats.mean_amount, stats.std_dev_amount) == (1, D("5"), None)
    summary, = result(spark, "q1_1_portfolio_summary", [on("01-01")])
    assert summary.std_dev_amount is None


def test_summary_counts_lines_and_distinct_values(spark):
    row, = result(spark, "q1_1_portfolio_summary", [
        on("01-01", transaction_id="A", amount_usd="0.01", customer_key=None),
        on("01-01", transaction_id="A", amount_usd="0.02", account_key=2),
        on("01-02", transaction_id="B", amount_usd="-4.00", customer_key=2, account_key=2)])
    assert tuple(row)[:8] == (3, 2, 2, 2, D("-3.97"), D("-1.32"), D("-4.00"), D("0.02"))


def test_summary_of_nothing(spark):
    row, = result(spark, "q1_1_portfolio_summary")
    assert tuple(row) == (0, 0, 0, 0, None, None, None, None, None)


def test_half_cent_average_rounds_up(spark):
    row, = result(spark, "q1_2_channel_mix", [
        on("01-01", amount_usd="0.01"), on("01-01", amount_usd="0.02")])
    assert row.avg_transaction_amount == D("0.02")


def test_channel_shares(spark):
    rows = result(spark, "q1_2_channel_mix", [
        on("01-01", channel="Web", amount_usd="1.00"),
        on("01-01", channel="Web", amount_usd="1.00"),
        on("01-01", channel=None, amount_usd="4.00")])
    assert [(r.channel, r.transaction_pct, r.volume_pct) for r in rows] == [
        (None, D("33.33"), D("66.67")), ("Web", D("66.67"), D("33.33"))]


def test_change_is_against_the_row_before(spark):
    rows = result(spark, "q1_3_monthly_trend", [
        on("01-05", amount_usd="100.00"), on("03-05", amount_usd="50.00"),
        on("04-05", amount_usd="0.00"), on("05-05", amount_usd="7.00")])
    assert [(r.month_number, r.mom_volume_change, r.mom_change_pct) for r in rows] == [
        (1, None, None), (3, D("-50.00"), D("-50.00")), (4, D("-50.00"), D("-100.00")),
        (5, D("7.00"), None)]


def test_kyc_keeps_customers_without_transactions(spark):
    rows = result(
        spark, "q1_4_kyc_distribution", [on("01-01", customer_key=1), on("01-01", customer_key=99)],
        customer=[dict(customer_key=1), dict(customer_key=2),
                  dict(customer_key=3, kyc_status="Expired")])
    assert [tuple(r) for r in rows] == [
        ("Verified", 2, 1, D("10.00"), D("10.00"), D("66.67")),
        ("Expired", 1, 0, None, None, D("33.33"))]


# --- anomalies ----------------------------------------------------------------

@pytest.mark.parametrize("hour, label", [
    (0, "Transition Hours"), (1, "Off-Hours (1AM-4AM)"), (4, "Off-Hours (1AM-4AM)"),
    (5, "Transition Hours"), (7, "Transition Hours"), (8, "Business Hours (8AM-6PM)"),
    (18, "Business Hours (8AM-6PM)"), (19, "Transition Hours"), (None, "Transition Hours")])
def test_hour_buckets(spark, hour, label):
    row, = result(spark, "q2_1_time_window", [on("01-01", transaction_hour=hour)])
    assert row.time_window == label


def test_outliers_need_more_than_three_deviations_and_all_dimensions(spark):
    usual = [on("01-01", amount_usd="10.00") for _ in range(30)]
    fact = usual + [on("01-02", amount_usd="900.00"), on("01-02", amount_usd="900.00"),
                    on("01-02", amount_usd="900.00", merchant_key=None)]
    rows = result(spark, "q2_3_zscore_outliers", fact)
    assert [r.transaction_id for r in rows] == ["T31", "T32"]
    assert rows[0].z_score == D("3.11")
    unrounded = inputs(spark, fact)
    score = float((D("900") - rows[0].mean_amount)) / rows[0].std_dev_amount
    above = anomaly.zscore_outliers(
        unrounded.base, unrounded.stats, unrounded.star.customer, unrounded.star.merchant,
        unrounded.star.location, threshold=score + 0.001)
    assert above.count() == 0
    assert result(spark, "q2_3_zscore_outliers", usual) == []  # no spread, no score


def test_rolling_mean_counts_rows_not_days(spark):
    days = ["01-01", "01-02", "01-04", "01-05", "01-07", "01-08", "01-10", "01-12"]
    rows = result(spark, "q2_4_daily_spikes", [
        on(day, amount_usd=amount) for day, amount in
        zip(days, ["700", "10", "10", "10", "10", "10", "10", "30"])])
    by_day = {r.transaction_date.day: r for r in rows}
    assert by_day[1].spike_ratio == D("1.00")
    assert by_day[10].rolling_7d_avg_usd == D("108.57")
    assert by_day[12].rolling_7d_avg_usd == D("12.86")
    assert (by_day[12].spike_ratio, by_day[12].spike_flag) == (D("2.33"), "SPIKE DETECTED")
    assert rows[0].transaction_date.day == 12


@pytest.mark.parametrize("first, second, ratio, flag", [
    ("100.00", "300.00", "1.50", "Elevated"), ("100.00", "299.00", "1.50", "Elevated"),
    ("100.00", "297.00", "1.50", "Elevated"), ("100.00", "296.00", "1.49", "Normal"),
    ("0.00", "5.00", "2.00", "SPIKE DETECTED"), ("0.00", "0.00", None, "Normal")])
def test_spike_flag_looks_at_the_rounded_ratio(spark, first, second, ratio, flag):
    rows = result(spark, "q2_4_daily_spikes", [
        on("01-01", amount_usd=first), on("01-02", amount_usd=second)])
    last = next(r for r in rows if r.transaction_date.day == 2)
    assert (last.spike_ratio, last.spike_flag) == (None if ratio is None else D(ratio), flag)


# --- profiles -----------------------------------------------------------------

def period(day, amounts, hour=12, **more):
    return [on(day, hour, amount_usd=a, **more) for a in amounts]


@pytest.mark.parametrize("late_amount, late_hour, flag", [
    ("50.00", 16, "HIGH RISK — Likely Takeover"), ("50.00", 8, "HIGH RISK — Likely Takeover"),
    ("50.00", 15, "MEDIUM RISK — Investigate"), ("49.99", 16, "MEDIUM RISK — Investigate"),
    ("30.00", 12, "MEDIUM RISK — Investigate"), ("29.99", 16, "Normal Behaviour")])
def test_takeover_flags(spark, late_amount, late_hour, flag):
    row, = result(spark, "q3_1_account_takeover",
                  period("04-30", ["10.00"] * 3) + period("05-01", [late_amount] * 5, late_hour))
    assert row.takeover_flag == flag
    assert row.hour_shift == abs(late_hour - 12)


def test_takeover_needs_rows_on_both_sides(spark):
    early, late = period("04-30", ["10.00"] * 3), period("05-01", ["10.00"] * 5)
    assert len(result(spark, "q3_1_account_takeover", early + late)) == 1
    assert result(spark, "q3_1_account_takeover", early[1:] + late) == []
    assert result(spark, "q3_1_account_takeover", early + late[1:]) == []
    nowhere = period("05-01", ["10.00"], location_key=None)
    assert result(spark, "q3_1_account_takeover", early + late[1:] + nowhere) == []


def test_takeover_without_early_spending(spark):
    row, = result(spark, "q3_1_account_takeover",
                  period("04-30", ["0.00"] * 3) + period("05-01", ["90.00"] * 5, 20))
    assert (row.spend_multiplier, row.takeover_flag) == (None, "Normal Behaviour")


def test_takeover_early_rows_need_no_location(spark):
    row, = result(spark, "q3_1_account_takeover",
                  period("04-30", ["10.00"] * 3, location_key=None)
                  + period("05-01", ["10.00"] * 5)
                  + period("05-02", ["10.00"], location_key=2)
                  + period("05-02", ["99.00"], location_key=77),
                  location=[dict(location_key=1), dict(location_key=2, country="AWAY")])
    assert (row.early_txn_count, row.late_txn_count, row.distinct_countries_late) == (3, 6, 2)
    assert row.late_avg_spend == D("10.00")


def test_geo_mismatch(spark):
    risky = [dict(location_key=1, country="HOME", is_high_risk_country=True),
             dict(location_key=2, country="AWAY", is_high_risk_country=True),
             dict(location_key=3, country="CALM", is_high_risk_country=False),
             dict(location_key=4, country="AWAY", is_high_risk_country=True)]
    fact = (period("01-01", ["1"] * 5, location_key=1) + period("01-01", ["1"] * 5, location_key=3)
            + period("01-02", ["1"] * 2, location_key=2) + period("02-02", ["2"], location_key=4))
    row, = result(spark, "q3_2_geo_anomaly", fact, location=risky)
    assert (row.transaction_country, row.foreign_transaction_count) == ("AWAY", 3)
    assert (row.foreign_volume_usd, row.avg_foreign_txn_value) == (D("4"), D("1.33"))
    assert (row.first_foreign_txn, row.last_foreign_txn) == (dt.date(2024, 1, 2), dt.date(2024, 2, 2))
    assert result(spark, "q3_2_geo_anomaly", fact[:-1], location=risky) == []
    assert result(spark, "q3_2_geo_anomaly", fact, location=risky,
                  customer=[dict(customer_key=5)]) == []
    assert result(spark, "q3_2_geo_anomaly", fact, location=risky,
                  customer=[dict(country=None)]) == []


# --- exposure -----------------------------------------------------------------

def test_merchant_rank_leaves_gaps_after_ties(spark):
    fact = [on("01-01", merchant_key=m, is_flagged=flag) for m, flag in
            [(1, True), (2, True), (3, False), (4, True), (4, True), (None, True), (9, True)]]
    rows = result(spark, "q4_1_merchant_risk", fact,
                  merchant=[dict(merchant_key=m) for m in (1, 2, 3, 4, 5)])
    assert [(r.merchant_key, r.flagged_count, r.risk_rank) for r in rows] == [
        (4, 2, 1), (1, 1, 2), (2, 1, 2), (3, 0, 4)]


def test_merchant_rank_equals_rank(spark):
    fact = [on("01-01", merchant_key=m, is_flagged=(m * k) % 7 < 3)
            for m in range(40) for k in range(m % 9 + 1)]
    d = inputs(spark, fact, merchant=[dict(merchant_key=m) for m in range(40)])
    rows = exposure.merchant_risk(d.base, d.star.merchant)
    from pyspark.sql import Window
    ranked = rows.withColumn("plain", F.rank().over(Window.orderBy(F.desc("flagged_count"))))
    assert ranked.filter("plain <> risk_rank").count() == 0
    assert ranked.count() == 40


def test_shell_flows_merge_merchants_of_one_name(spark):
    shells = [dict(merchant_key=1, merchant_name="S", is_shell_merchant=True),
              dict(merchant_key=2, merchant_name="S", is_shell_merchant=True),
              dict(merchant_key=3, merchant_name="N", is_shell_merchant=False)]
    rows = result(spark, "q4_2_shell_flows",
                  [on("01-01", merchant_key=m, customer_key=c) for m, c in
                   [(1, 1), (2, 1), (2, 2), (3, 1)]]
                  + [on("01-01", merchant_key=1, location_key=None)], merchant=shells)
    assert [(r.merchant_name, r.transaction_count, r.unique_customers) for r in rows] == [("S", 3, 2)]


def test_channel_risk(spark):
    rows = result(spark, "q4_3_channel_risk", [
        on("01-01", channel="A", amount_usd="0.00"),
        on("01-01", channel="B", amount_usd="1.00", is_flagged=True),
        on("01-01", channel="B", amount_usd="2.00")])
    assert [(r.channel, r.flagged_rate_pct, r.flagged_volume_usd, r.pct_volume_flagged)
            for r in rows] == [("B", D("50.00"), D("1.00"), D("33.33")),
                               ("A", D("0.00"), D("0.00"), None)]


def test_country_share_is_of_located_volume(spark):
    rows = result(spark, "q4_4_country_exposure",
                  [on("01-01", location_key=1, amount_usd="1"),
                   on("01-01", location_key=2, amount_usd="3"),
                   on("01-01", location_key=None, amount_usd="100")],
                  location=[dict(location_key=1), dict(location_key=2, country="AWAY")])
    assert {r.country: r.pct_of_total_volume for r in rows} == {"HOME": D("25.00"), "AWAY": D("75.00")}


# --- report -------------------------------------------------------------------

def test_unflagged_input(spark):
    fact = [on("01-01", amount_usd="10.00")]
    summary, = result(spark, "q6_1_exec_summary", fact)
    assert (summary.estimated_fraud_exposure_usd, summary.fraud_rate_pct) == (D("0.00"), D("0.00"))
    assert result(spark, "q6_2_exposure_by_type", fact) == []
    assert result(spark, "q6_3_fraud_trend", fact) == []
    assert [r.metric for r in result(spark, "q6_5_kpi_report", fact)] == [
        "TOTAL TRANSACTIONS REVIEWED", "TOTAL FRAUD EXPOSURE (USD)", "FRAUD RATE (%)",
        "ACCOUNTS RECOMMENDED FOR FREEZE"]


def test_unknown_fraud_type_is_a_group(spark):
    rows = result(spark, "q6_2_exposure_by_type", [
        on("01-01", is_flagged=True, fraud_type=None, amount_usd="3"),
        on("01-01", is_flagged=True, fraud_type="Velocity", amount_usd="1")])
    assert [(r.fraud_type, r.pct_of_total_exposure) for r in rows] == [
        (None, D("75.00")), ("Velocity", D("25.00"))]


def test_fraud_trend_skips_months_without_flagged_rows(spark):
    rows = result(spark, "q6_3_fraud_trend", [
        on("01-05", is_flagged=True, amount_usd="100"), on("02-05"),
        on("03-05", is_flagged=True, amount_usd="150")])
    assert [(r.month_name, r.mom_exposure_change_usd, r.mom_change_pct) for r in rows] == [
        ("Jan", None, None), ("Mar", D("50.00"), D("50.00"))]


def account(flagged, unflagged, amount, key=1):
    return ([on("01-01", is_flagged=True, amount_usd=amount, account_key=key)] * flagged
            + [on("01-02", account_key=key)] * unflagged)


@pytest.mark.parametrize("flagged, unflagged, amount, action", [
    (14, 6, "5000.00", "FREEZE IMMEDIATELY"),             # 70 %, 70,000
    (10, 0, "5000.00", "FREEZE IMMEDIATELY"),             # 100 %, 50,000
    (10, 0, "4999.99", "ESCALATE TO COMPLIANCE"),
    (10, 10, "1.00", "ESCALATE TO COMPLIANCE"),           # 50 %
    (10, 90, "2500.00", "ESCALATE TO COMPLIANCE"),        # 25,000
    (12, 28, "1.00", "ENHANCED MONITORING"),              # 30 %
    (10, 25, "2499.99", "FLAG FOR REVIEW")])              # 28.57 %
def test_actions(spark, flagged, unflagged, amount, action):
    row, = result(spark, "q6_4_freeze_list", account(flagged, unflagged, amount))
    assert row.recommended_action == action


def test_freeze_list_needs_ten_flagged_rows_and_both_dimensions(spark):
    assert result(spark, "q6_4_freeze_list", account(9, 0, "9000.00")) == []
    fact = account(10, 0, "9000.00")
    assert result(spark, "q6_4_freeze_list", fact, account=[dict(account_key=7)]) == []
    assert result(spark, "q6_4_freeze_list", fact, customer=[dict(customer_key=7)]) == []


def test_freeze_rules_differ_at_the_rounded_rate(spark):
    """69.995 % is 70.00 on the list and below 70 in the count."""
    flagged = spark.range(13999).select(F.lit(True).alias("is_flagged"), F.lit(10).alias("a"))
    others = spark.range(6001).select(F.lit(False).alias("is_flagged"), F.lit(10).alias("a"))
    base = foundation.flagged_base(flagged.union(others).select(
        F.lit(1).alias("customer_key"), F.lit(1).alias("account_key"), "is_flagged",
        F.lit(False).alias("is_off_hours"), F.col("a").cast("decimal(18,2)").alias("amount_usd"),
        F.lit(dt.date(2024, 1, 1)).alias("transaction_date"), F.lit("ATM").alias("channel"),
        F.lit("Velocity").alias("fraud_type")))
    star = make_star(spark, [on("01-01")])
    row, = report.freeze_list(base, star.customer, star.account).collect()
    assert (row.flagged_rate_pct, row.recommended_action) == (D("70.00"), "FREEZE IMMEDIATELY")
    report_rows = report.kpi_report(report.exec_summary(base), base).collect()
    assert report_rows[-1].value == "0"


def test_top_n_ties_go_to_the_smaller_account(spark):
    fact = account(10, 0, "1.00", key=2) + account(10, 0, "1.00", key=1)
    d = inputs(spark, fact)
    rows = report.freeze_list(d.base, d.star.customer, d.star.account, n=1).collect()
    assert [r.account_id for r in rows] == ["ACC1"]


def test_key_figures(spark):
    fact = (account(10, 0, "123456.75") + account(1, 0, "5.00", key=2)
            + [on("01-01", channel="Web", is_flagged=True, fraud_type="Velocity", amount_usd="2.00")])
    rows = result(spark, "q6_5_kpi_report", fact)
    assert [r.value for r in rows] == ["12", "$1,234,575", "100.00%", "ATM", None, "1"]


def test_exposure_in_text_rounds_half_away_from_zero(spark):
    rows = result(spark, "q6_5_kpi_report", [on("01-01", is_flagged=True, amount_usd="2.50")])
    assert rows[1].value == "$3"


def test_operators_do_not_need_names_of_the_test_mapping(spark):
    d = inputs(spark, [on("01-01")])
    assert baseline.channel_mix(d.base).count() == 1
    assert profiling.CUTOFF == dt.date(2024, 5, 1)
