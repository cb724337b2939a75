"""Rapid pairs and gaps against brute force over single rows."""

import datetime as dt
from collections import defaultdict
from decimal import Decimal
from random import Random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskmart.operators.foundation import flagged_base
from riskmart.operators.velocity import rapid_gaps, rapid_pairs
from stars import make_star
from test_numeric import half_up

DAY = dt.datetime(2024, 3, 1)
RELAXED = settings(max_examples=5, deadline=None,
                   suppress_health_check=[HealthCheck.function_scoped_fixture])


def at(text, **more):
    return dict(transaction_datetime=dt.datetime.fromisoformat(f"2024-03-{text}"), **more)


def minutes_apart(a, b):
    return int((b.replace(second=0, microsecond=0) - a.replace(second=0, microsecond=0))
               .total_seconds() // 60)


def brute_pairs(rows, max_minutes, min_pairs):
    pairs = defaultdict(list)
    for a in rows:
        for b in rows:
            ta, tb = a["transaction_datetime"], b["transaction_datetime"]
            if (a["customer_key"] == b["customer_key"] and ta.date() == tb.date()
                    and None not in (a["transaction_id"], b["transaction_id"])
                    and a["transaction_id"] != b["transaction_id"] and tb > ta
                    and minutes_apart(ta, tb) <= max_minutes):
                both = (None if None in (a["amount_usd"], b["amount_usd"])
                        else a["amount_usd"] + b["amount_usd"])
                pairs[a["customer_key"]].append((minutes_apart(ta, tb), both))
    return {
        key: (len(found), min(g for g, _ in found),
              half_up(sum(g for g, _ in found), len(found), 1),
              half_up(sum(b for _, b in found if b is not None), 2, 2)
              if any(b is not None for _, b in found) else None)
        for key, found in pairs.items() if len(found) >= min_pairs}


def brute_gaps(rows, max_minutes, min_count):
    by_customer = defaultdict(list)
    for row in rows:
        by_customer[row["customer_key"]].append(row)
    result = {}
    for key, mine in by_customer.items():
        mine.sort(key=lambda r: (r["transaction_datetime"], r["transaction_key"]))
        found = [
            (minutes_apart(a["transaction_datetime"], b["transaction_datetime"]), b["amount_usd"])
            for a, b in zip(mine, mine[1:])]
        found = [(gap, amount) for gap, amount in found if gap <= max_minutes]
        if len(found) >= min_count:
            amounts = [amount for _, amount in found if amount is not None]
            result[key] = (len(found), min(g for g, _ in found),
                           half_up(sum(g for g, _ in found), len(found), 1),
                           sum(amounts) if amounts else None)
    return result


transactions = st.lists(st.fixed_dictionaries(dict(
    customer_key=st.integers(1, 2),
    transaction_id=st.one_of(st.sampled_from(["A", "B", "C"]), st.none(), st.uuids().map(str)),
    transaction_datetime=st.one_of(
        st.integers(0, 130).map(lambda m: DAY + dt.timedelta(hours=22, minutes=m)),
        st.integers(0, 130).map(lambda s: DAY + dt.timedelta(hours=22, seconds=s)),
        st.integers(0, 40).map(lambda s: DAY + dt.timedelta(hours=23, milliseconds=s * 100))),
    amount_usd=st.one_of(st.none(), st.decimals(0, 100, places=2), st.decimals(0, 100, places=2)),
)), min_size=1, max_size=40)


@RELAXED
@given(transactions, st.sampled_from([0, 1, 5, 60]))
def test_pairs_equal_brute_force(spark, rows, max_minutes):
    star = make_star(spark, rows)
    found = rapid_pairs(flagged_base(star.fact), star.customer, max_minutes, 1, None).collect()
    assert {r.customer_key: (r.rapid_pair_count, r.min_gap_minutes, r.avg_gap_minutes,
                             r.approx_volume_usd) for r in found} == brute_pairs(rows, max_minutes, 1)


@RELAXED
@given(transactions, st.sampled_from([0, 1, 5, 60]))
def test_gaps_equal_brute_force(spark, rows, max_minutes):
    rows = [dict(row, transaction_key=place) for place, row in enumerate(rows)]
    star = make_star(spark, rows)
    found = rapid_gaps(flagged_base(star.fact), star.customer, max_minutes, 1, None).collect()
    assert {r.customer_key: (r.rapid_txn_count, r.min_gap_minutes, r.avg_gap_minutes,
                             r.rapid_window_volume_usd) for r in found} == brute_gaps(rows, max_minutes, 1)


def random_rows(seed, customers):
    """Customers with different mixes of repeated ids, equal instants and gaps."""
    random = Random(seed)
    rows = []
    for customer in range(customers):
        ids = random.choice([["A"], ["A", "B"], list("ABCDE"), None])
        span = random.choice([90, 3600, 20000])
        step = random.choice([1, 20, 60])
        for _ in range(random.randint(1, 14)):
            rows.append(dict(
                customer_key=customer, transaction_key=len(rows),
                transaction_id=random.choice(ids) if ids else f"T{len(rows)}",
                transaction_datetime=DAY + dt.timedelta(
                    hours=20, seconds=random.randrange(0, span, step)),
                amount_usd=random.choice([None, Decimal("1.25"), Decimal("7.10"), Decimal("0.01")])))
    return rows


@pytest.mark.parametrize("seed, max_minutes", [(1, 60), (2, 60), (3, 7), (4, 1), (5, 0)])
def test_many_customers_equal_brute_force(spark, seed, max_minutes):
    rows = random_rows(seed, 250)
    star = make_star(spark, rows)
    base = flagged_base(star.fact)
    pairs = rapid_pairs(base, star.customer, max_minutes, 1, None).collect()
    gaps = rapid_gaps(base, star.customer, max_minutes, 1, None).collect()
    expected_pairs, expected_gaps = {}, {}
    for customer in range(250):
        mine = [row for row in rows if row["customer_key"] == customer]
        expected_pairs.update(brute_pairs(mine, max_minutes, 1))
        expected_gaps.update(brute_gaps(mine, max_minutes, 1))
    assert {r.customer_key: tuple(r)[4:] for r in pairs} == expected_pairs
    assert {r.customer_key: tuple(r)[4:] for r in gaps} == expected_gaps


@RELAXED
@given(transactions)
def test_pairs_with_a_key_as_id(spark, rows):
    rows = [dict(row, transaction_id=f"T{place}") for place, row in enumerate(rows)]
    star = make_star(spark, rows)
    base = flagged_base(star.fact)
    given_unique = rapid_pairs(base, star.customer, 60, 1, None, ids_unique=True).collect()
    assert given_unique == rapid_pairs(base, star.customer, 60, 1, None).collect()


def gaps_of(spark, rows, **limits):
    star = make_star(spark, rows)
    return rapid_gaps(flagged_base(star.fact), star.customer, **{"min_count": 1, **limits}).collect()


def pairs_of(spark, rows, **limits):
    star = make_star(spark, rows)
    return rapid_pairs(flagged_base(star.fact), star.customer, **{"min_pairs": 1, **limits}).collect()


def test_minute_boundary(spark):
    rows = [at("01 00:00:59"), at("01 00:01:01")]
    assert gaps_of(spark, rows)[0].min_gap_minutes == 1
    assert pairs_of(spark, rows)[0].min_gap_minutes == 1


@pytest.mark.parametrize("later, kept", [("01 11:00:59", 1), ("01 11:01:00", 0)])
def test_sixty_minutes_are_kept_sixty_one_dropped(spark, later, kept):
    rows = [at("01 10:00:00"), at(later)]
    assert len(gaps_of(spark, rows)) == kept
    assert len(pairs_of(spark, rows)) == kept


def test_only_gaps_cross_midnight(spark):
    rows = [at("01 23:50:00"), at("02 00:10:00")]
    assert gaps_of(spark, rows)[0].min_gap_minutes == 20
    assert pairs_of(spark, rows) == []


def test_equal_instants_are_a_gap_but_no_pair(spark):
    rows = [at("01 10:00:00", amount_usd="1.00"), at("01 10:00:00", amount_usd="2.00")]
    gap, = gaps_of(spark, rows)
    assert (gap.rapid_txn_count, gap.min_gap_minutes) == (1, 0)
    assert gap.rapid_window_volume_usd == Decimal("2.00")
    assert pairs_of(spark, rows) == []


def test_lines_of_one_transaction_form_no_pair(spark):
    lines = [at("01 10:00:00", transaction_id="X"), at("01 10:05:00", transaction_id="X")]
    assert pairs_of(spark, lines) == []
    other = pairs_of(spark, [*lines, at("01 10:30:00", transaction_id="Y")])[0]
    assert (other.rapid_pair_count, other.min_gap_minutes) == (2, 25)


def test_five_are_needed_and_ties_go_to_the_smaller_key(spark):
    def burst(customer, count):
        return [at(f"01 10:0{m}:00", customer_key=customer) for m in range(count)]

    rows = burst(3, 6) + burst(2, 6) + burst(1, 5) + burst(4, 7)
    assert [r.customer_key for r in gaps_of(spark, rows, min_count=5)] == [4, 2, 3]
    assert [r.customer_key for r in gaps_of(spark, rows, min_count=5, n=2)] == [4, 2]


def test_a_customer_without_a_row_in_the_dimension_is_left_out(spark):
    rows = [at("01 10:00:00"), at("01 10:01:00")]
    star = make_star(spark, rows, customer=[dict(customer_key=9)])
    base = flagged_base(star.fact)
    assert rapid_gaps(base, star.customer, min_count=1).collect() == []
    assert rapid_pairs(base, star.customer, min_pairs=1).collect() == []


def test_one_busy_customer(spark):
    """A third of all rows in one customer, most of them in one minute."""
    n = 30000
    rows = spark.range(n).select(
        F.col("id").alias("transaction_key"),
        F.concat(F.lit("T"), "id").alias("transaction_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("customer_key"),
        F.lit(dt.date(2024, 3, 1)).alias("transaction_date"),
        F.expr("timestamp_ntz'2024-03-01 10:00:00'"
               " + make_dt_interval(0, 0, 0, cast(id as decimal(18,6)) / 1000)")
        .alias("transaction_datetime"),
        F.lit(1).cast("decimal(18,2)").alias("amount_usd"))
    customers = rows.select(
        "customer_key", F.lit("x").alias("full_name"), F.lit("x").alias("country"),
        F.lit("x").alias("kyc_status")).distinct()
    busy = n // 3
    pair, = rapid_pairs(rows, customers).collect()
    assert pair.rapid_pair_count == busy * (busy - 1) // 2
    assert pair.approx_volume_usd == Decimal(busy * (busy - 1) // 2)
    gap, = rapid_gaps(rows, customers).collect()
    assert (gap.rapid_txn_count, gap.rapid_window_volume_usd) == (busy - 1, busy - 1)


def test_large_amounts_of_many_pairs_do_not_overflow(spark):
    big = "9999999999999999.99"
    rows = [at(f"01 10:00:{s:02d}", amount_usd=big) for s in range(3)] + [
        at(f"01 10:0{m}:30", amount_usd=big) for m in range(1, 6)]
    pair, = pairs_of(spark, rows)
    assert (pair.rapid_pair_count, pair.approx_volume_usd) == (28, 28 * Decimal(big))
