"""Clustered storage, the one scan of the stored run, and monthly sums."""

import datetime as dt
import math
import re
from random import Random

import pytest

from riskmart.operators import foundation, report
from riskmart.plans import investigation, monthly
from riskmart.plans.investigation import BY_LABEL, run_all
from riskmart.queries import LABELS, QUERIES, Inputs, label_totals
from riskmart.sources import read_clustered, read_star, testdata, write_clustered, write_star
from stars import make_star
from test_plans import plan_of
from test_random_stars import random_star

SF = "/root/testdata/sf0.001"
BY_CUSTOMER = ["q2_2b_rapid_gaps", "s5_off_hours_signal", "s5_spend_spike_signal",
               "s5_shell_signal", "s5_geo_signal", "s5_scored"]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("star") / "star")
    star = testdata.star(spark, SF)
    write_star(star, path)
    assert write_clustered(star, path, 4)
    return path


@pytest.mark.parametrize("name", BY_CUSTOMER)
def test_groups_by_customer_need_no_exchange_of_the_fact(spark, path, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(QUERIES[name](Inputs(read_clustered(spark, path))))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Bucketed: true" in plan
    assert "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_clustered_results_are_the_same(spark, path, name):
    expected = QUERIES[name](Inputs(read_star(spark, path))).collect()
    found = QUERIES[name](Inputs(read_clustered(spark, path))).collect()
    if name == "f2_portfolio_stats":
        expected, found = ([(r.total_rows, r.mean_amount, round(r.std_dev_amount, 6)) for r in x]
                           for x in (expected, found))
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_a_customer_with_a_third_of_the_rows_is_not_clustered(spark, tmp_path):
    rows = [dict(customer_key=1 if i % 3 == 0 else 10 + i, account_key=1) for i in range(900)]
    star, path = make_star(spark, rows), str(tmp_path / "star")
    write_star(star, path)
    assert not write_clustered(star, path, 20)
    fact = read_clustered(spark, path).fact
    assert fact.count() == 900
    assert "Bucketed: true" not in plan_of(fact.groupBy("customer_key").count())


def test_empty_fact_can_be_clustered(spark, tmp_path):
    star, path = make_star(spark, []), str(tmp_path / "star")
    write_star(star, path)
    assert write_clustered(star, path, 4)
    assert read_clustered(spark, path).fact.count() == 0


@pytest.mark.parametrize("seed", [21, 22])
def test_label_reports_equal_their_own_scans(spark, seed):
    star = random_star(spark, seed)
    stored = {LABELS: label_totals(Inputs(star)).cache()}
    for name in BY_LABEL:
        alone, together = QUERIES[name](Inputs(star)), QUERIES[name](Inputs(star, stored))
        assert alone.schema.names == together.schema.names
        assert [f.dataType for f in alone.schema if f.name.endswith("_pct")] == [
            f.dataType for f in together.schema if f.name.endswith("_pct")]
        assert list(map(repr, alone.collect())) == list(map(repr, together.collect())), name


def test_label_reports_of_no_rows(spark):
    star = make_star(spark, [])
    stored = {LABELS: label_totals(Inputs(star))}
    for name in BY_LABEL:
        assert QUERIES[name](Inputs(star)).collect() == QUERIES[name](Inputs(star, stored)).collect()


def test_the_stored_run_reads_the_fact_once_for_label_reports(spark, path, tmp_path, monkeypatch):
    plans = {}

    def watched(name, query):
        def run(inputs):
            frame = query(inputs)
            plans[name] = plan_of(frame)
            return frame
        return run

    monkeypatch.setattr(investigation, "QUERIES", {n: watched(n, QUERIES[n]) for n in BY_LABEL})
    monkeypatch.setattr(investigation, "label_totals", watched(LABELS, label_totals))
    run_all(spark, read_star(spark, path), str(tmp_path / "out"), BY_LABEL)
    scans = {n: len(re.findall(r"FileScan[^\n]*fact_transactions", p)) for n, p in plans.items()}
    assert scans == {LABELS: 1, **dict.fromkeys(BY_LABEL, 0)}


def same_stats(a, b):
    assert (a.total_rows, a.mean_amount, a.total_flagged) == (b.total_rows, b.mean_amount, b.total_flagged)
    assert (a.std_dev_amount is None) == (b.std_dev_amount is None)
    assert a.std_dev_amount is None or math.isclose(a.std_dev_amount, b.std_dev_amount, rel_tol=1e-12)


@pytest.mark.parametrize("seed", [31, 32, 33])
def test_merged_months_equal_the_whole(spark, seed):
    base = foundation.flagged_base(random_star(spark, seed).fact).cache()
    partials = foundation.monthly_partials(base)
    same_stats(foundation.merged_stats(partials).head(), foundation.portfolio_stats(base).head())
    assert monthly.exec_summary(partials).collect() == report.exec_summary(base).collect()


@pytest.mark.parametrize("rows", [[], [dict(amount_usd=None)], [dict(amount_usd=3)],
                                  [dict(amount_usd="9999999999999.99"), dict(amount_usd="9999999999999.98")]])
def test_merged_months_of_few_rows(spark, rows):
    base = foundation.flagged_base(make_star(spark, rows).fact)
    partials = foundation.monthly_partials(base)
    same_stats(foundation.merged_stats(partials).head(), foundation.portfolio_stats(base).head())


def test_a_new_month_is_read_alone(spark, tmp_path):
    random = Random(5)

    def rows(month, n):
        return [dict(transaction_datetime=dt.datetime(2024, month, random.randint(1, 28), 9),
                     amount_usd=random.randrange(1, 900), transaction_key=100 * month + i,
                     is_flagged=random.random() < 0.3) for i in range(n)]

    first, second = rows(1, 30) + rows(2, 40), rows(3, 20)
    star, out = str(tmp_path / "star"), str(tmp_path / "out")
    write_star(make_star(spark, first), star)
    monthly.refresh(spark, star, out)
    kept = {r.month: r for r in monthly.stored(spark, out).collect()}
    write_star(make_star(spark, first[:5] + second), star, "overwrite")  # January cut, March new
    found = monthly.refresh(spark, star, out, ["2024-03"])
    assert {r.month: r for r in found.collect() if r.month != "2024-03"} == kept
    base = foundation.flagged_base(make_star(spark, first + second).fact)
    same_stats(monthly.portfolio_stats(found).head(), foundation.portfolio_stats(base).head())
    assert monthly.exec_summary(found).collect() == report.exec_summary(base).collect()
