"""Random stars with unknown keys, repeated ids, ties and gaps, against the oracles."""

import datetime as dt
from decimal import Decimal
from random import Random

import duckdb
import pytest

import __spark_entry__ as entry_point
from riskmart.oracle import STAR_ORACLES
from riskmart.queries import QUERIES, Inputs
from riskmart.sources import TABLES
from stars import calendar, make_star
from test_oracle import as_rows

KINDS = ["Account Takeover", "Velocity", None]


def random_star(spark, seed):
    random = Random(seed)
    start = dt.datetime(2024, 3, 20)
    rows = []
    for place in range(900):
        customer = random.choice([0, 0, 0, *range(12), None])  # 0 holds a good third
        flagged = random.random() < (0.8 if customer in (0, 3) else 0.2)
        moment = start + dt.timedelta(
            days=random.choice([0, 1, 2, 5, 30, 45, 46, 75, 130]),
            seconds=random.randrange(0, 86400, random.choice([1, 20, 600])))
        rows.append(dict(
            transaction_key=place, transaction_id=f"T{random.randrange(700)}",
            customer_key=customer, account_key=random.randrange(15),
            merchant_key=random.choice([None, *range(9)]),
            location_key=random.choice([None, *range(9)]),
            transaction_datetime=moment,
            transaction_hour=random.choice([moment.hour, moment.hour, None]),
            channel=random.choice(["Web", "ATM", "POS"]),
            amount_usd=Decimal(
                random.choice([9999999, 12345678]) if random.random() < 0.03
                else random.choice([0, 1, 2, 3, random.randrange(10 ** 5)])) / 100
            if random.random() < 0.95 else None,
            is_flagged=flagged if random.random() < 0.97 else None,
            is_off_hours=None if customer == 7 else random.choice([True, False, False, None]),
            fraud_type=random.choice(KINDS) if flagged else None))
    days = sorted({r["transaction_datetime"].date() for r in rows})
    return make_star(
        spark, rows,
        customer=[dict(customer_key=k, full_name=f"C{k}", country=random.choice(["A", "B", None]),
                       kyc_status=random.choice(["Verified", "Pending", "Expired", None]))
                  for k in range(-3, 10)],
        account=[dict(account_key=k, account_id=f"ACC{k}") for k in range(13)],
        merchant=[dict(merchant_key=k, merchant_name=f"M{k % 5}", is_shell_merchant=k < 3)
                  for k in range(7)],
        location=[dict(location_key=k, country="ABCD"[k % 4], is_high_risk_country=k % 4 < 2)
                  for k in range(7)],
        date=calendar(days[:-1]))


@pytest.fixture(scope="module", params=[11, 12, 13])
def both(spark, request):
    star = random_star(spark, request.param)
    con = duckdb.connect()
    for table, (attribute, _) in TABLES.items():
        arrow = getattr(star, attribute).toArrow()
        con.register("incoming", arrow)
        con.execute(f"create table {table} as select * from incoming")
        con.unregister("incoming")
    return Inputs(star), con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(both, name):
    inputs, con = both
    frame = entry_point.shown(name, QUERIES[name](inputs))
    found = as_rows(frame.columns, [tuple(row) for row in frame.collect()])
    assert found
    result = con.execute(STAR_ORACLES[name])
    names = [column[0] for column in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert found == as_rows(names, result.fetchall())
