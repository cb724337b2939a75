"""Physical plans: what is read, what is shuffled, and independence of the join strategy."""

import re

import pytest

from riskmart.operators import scoring
from riskmart.queries import QUERIES, Inputs
from riskmart.sources import read_star, testdata, write_star

SF = "/root/testdata/sf0.001"
#: joins that are broadcast by hint: the calendar and the positions of a score
HINTED = {"q1_3_monthly_trend": 1, "q6_3_fraud_trend": 1, "q5_1_watchlist": 1}


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("star") / "star")
    write_star(testdata.star(spark, SF), path)
    return path


@pytest.fixture(scope="module")
def stored(spark, path):
    return Inputs(read_star(spark, path))


def plan_of(frame, ran=False):
    if ran:
        frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    return text.split("\n+- == Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cartesian_product(stored, name):
    plan = plan_of(QUERIES[name](stored))
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name, columns", [
    ("q1_2_channel_mix", {"customer_key", "channel", "amount_usd"}),
    ("q4_3_channel_risk", {"channel", "amount_usd", "is_flagged"}),
    ("s5_off_hours_signal", {"customer_key", "is_off_hours"})])
def test_scans_read_only_named_columns(stored, name, columns):
    schema, = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES[name](stored)))
    assert set(re.findall(r"(\w+):", schema)) == columns


def test_flag_filter_reaches_the_scan(stored):
    plan = plan_of(QUERIES["q6_2_exposure_by_type"](stored))
    assert re.search(r"(PushedFilters|DataFilters): \[[^\]]*is_flagged", plan)


def test_watchlist_reads_the_fact_once(stored):
    plan = plan_of(QUERIES["q5_1_watchlist"](stored), ran=True)
    assert len(re.findall(r"FileScan parquet \[[^\]]*amount_usd", plan)) == 1
    assert "ReusedExchange" in plan


#: scans of the fact and exchanges by a hash, at most
SCANS_AND_EXCHANGES = {
    "q1_1_portfolio_summary": (3, 2),  # totals with two distinct counts, ids, deviation
    "q2_2a_rapid_pairs": (2, 5),
    "q2_2b_rapid_gaps": (1, 2),
    "q4_1_merchant_risk": (1, 4),
}


@pytest.mark.parametrize("name", SCANS_AND_EXCHANGES)
def test_scans_and_exchanges(spark, path, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(QUERIES[name](Inputs(read_star(spark, path))))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    scans, exchanges = SCANS_AND_EXCHANGES[name]
    assert len(re.findall(r"FileScan[^\n]*fact_transactions", plan)) <= scans
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", plan)) <= exchanges
    assert ("ReusedExchange" in plan) == (name == "q4_1_merchant_risk")


def test_signals_shuffle_groups_only(stored):
    plan = plan_of(scoring.signals(stored.base, stored.star.merchant, stored.star.location))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2


def test_gaps_order_minutes_not_transactions(stored):
    """The window follows an aggregate per customer and minute."""
    plan = plan_of(QUERIES["q2_2b_rapid_gaps"](stored))
    window = plan.index("Window [lag(minute")
    assert "Aggregate(key=[customer_key" in plan[window:]


SETTINGS = {
    "no broadcasts": {"spark.sql.autoBroadcastJoinThreshold": "-1",
                      "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"},
    "not adaptive": {"spark.sql.adaptive.enabled": "false"},
    "not ANSI": {"spark.sql.ansi.enabled": "false"},
}


@pytest.mark.parametrize("setting", SETTINGS)
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_results_do_not_depend_on_the_strategy(spark, stored, path, name, setting):
    expected = sorted(map(repr, QUERIES[name](stored).collect()))
    for key, value in SETTINGS[setting].items():
        spark.conf.set(key, value)
    try:
        # fresh inputs: a frame that ran before would keep the plan it ran with
        frame = QUERIES[name](Inputs(read_star(spark, path)))
        assert sorted(map(repr, frame.collect())) == expected
        if setting == "no broadcasts":
            joins = len(re.findall(r"BroadcastHashJoin", plan_of(frame)))
            assert joins <= HINTED.get(name, 0), plan_of(frame)
    finally:
        for key in SETTINGS[setting]:
            spark.conf.unset(key)


@pytest.mark.parametrize("name", [
    "s5_shell_signal", "s5_geo_signal", "s5_scored", "q5_1_watchlist", "q4_2_shell_flows"])
def test_rows_are_grouped_before_they_join_a_dimension(spark, path, name):
    """Without broadcasts no exchange by merchant or location moves single rows."""
    for key, value in SETTINGS["no broadcasts"].items():
        spark.conf.set(key, value)
    try:
        lines = plan_of(QUERIES[name](Inputs(read_star(spark, path)))).split("\n")
    finally:
        for key in SETTINGS["no broadcasts"]:
            spark.conf.unset(key)
    for place, line in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\((merchant_key|location_key)#\d+L?, \d+\)", line):
            below = "\n".join(lines[place:])
            first_scan = below.index("FileScan")
            assert "dim_" in below[first_scan:].split("\n")[0] or "Aggregate" in below[:first_scan]


def test_key_figures_scan_the_fact_three_times(stored):
    plan = plan_of(QUERIES["q6_5_kpi_report"](stored))
    assert len(re.findall(r"FileScan parquet", plan)) == 3


def test_outlier_bound_is_a_plain_filter_of_the_scan(stored):
    """Spark hands a comparison of a bare column with a subquery to Parquet when it runs."""
    plan = plan_of(QUERIES["q2_3_zscore_outliers"](stored))
    assert re.search(r"DataFilters: \[[^\n]*\(amount_usd#\d+ >= \w*[Ss]ubquery", plan)


def test_distinct_counts_do_not_expand_rows(stored):
    plan = plan_of(QUERIES["q1_1_portfolio_summary"](stored), ran=True)
    assert "Expand" not in plan


def test_outlier_bounds_are_computed_once(stored):
    plan = plan_of(QUERIES["q2_3_zscore_outliers"](stored), ran=True)
    assert len(set(re.findall(r"(?<!Reused)Subquery subquery#(\d+)", plan))) == 1
    assert "ReusedSubquery" in plan


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if f"{n}_all" in QUERIES))
def test_limited_lists_are_not_sorted_as_a_whole(stored, name):
    plan = plan_of(QUERIES[name](stored))
    assert "TakeOrderedAndProject" in plan
    assert "Exchange rangepartitioning" not in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_task_never_gets_single_rows(stored, name):
    """What moves into one partition is an aggregate: partial results, groups or positions."""
    lines = plan_of(QUERIES[name](stored)).split("\n")
    for place, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = next(x for x in lines[place + 1:] if not re.search(r"\+- (Project|Filter)", x))
            assert "Aggregate" in below, below
