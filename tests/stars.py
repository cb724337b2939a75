"""Small hand-made stars."""

import datetime as dt
from decimal import Decimal

from riskmart.sources import TABLES, Star

DEFAULTS = {
    "fact_transactions": dict(
        transaction_key=1, transaction_id=None, customer_key=1, account_key=1, merchant_key=1,
        location_key=1, date_key=None, transaction_date=None,
        transaction_datetime=dt.datetime(2024, 1, 10, 12, 0), transaction_hour=None,
        transaction_type="Transfer", channel="ATM", amount_usd=Decimal("10.00"),
        is_flagged=False, is_off_hours=False, fraud_type=None),
    "dim_customer": dict(
        customer_key=1, full_name="Customer 1", country="HOME", kyc_status="Verified",
        customer_segment="Retail", preferred_channel="ATM"),
    "dim_account": dict(
        account_key=1, account_id="ACC1", account_type="Savings", account_status="Active",
        current_balance=Decimal("5.00")),
    "dim_merchant": dict(
        merchant_key=1, merchant_name="Merchant 1", merchant_category="Retail",
        risk_rating="Low", is_shell_merchant=False, country="HOME"),
    "dim_location": dict(
        location_key=1, country="HOME", region="R", is_high_risk_country=False),
    "dim_date": dict(
        date_key=20240101, year_number=2024, month_number=1, month_name="Jan",
        quarter_name="Q1", day_of_week="Mon", is_weekend=False),
}


def _transaction(place, given):
    row = {**DEFAULTS["fact_transactions"], "transaction_key": place, **given}
    row["amount_usd"] = None if row["amount_usd"] is None else Decimal(str(row["amount_usd"]))
    if "transaction_id" not in given:
        row["transaction_id"] = f"T{row['transaction_key']}"
    moment = row["transaction_datetime"]
    if moment is not None:
        if "transaction_hour" not in given:
            row["transaction_hour"] = moment.hour
        if row["transaction_date"] is None:
            row["transaction_date"] = moment.date()
    day = row["transaction_date"]
    if day is not None and row["date_key"] is None:
        row["date_key"] = day.year * 10000 + day.month * 100 + day.day
    return row


def calendar(days):
    return [dict(
        date_key=d.year * 10000 + d.month * 100 + d.day, year_number=d.year,
        month_number=d.month, month_name=d.strftime("%b"),
        quarter_name=f"Q{(d.month + 2) // 3}", day_of_week=d.strftime("%a"),
        is_weekend=d.weekday() >= 5) for d in days]


def make_star(spark, fact=(), **dimensions):
    """A star with the given rows; missing columns take their default.

    Dimensions default to the customers, accounts and days the fact names and to
    one merchant and one location.
    """
    rows = {"fact_transactions": [_transaction(i, r) for i, r in enumerate(fact, 1)]}
    found = rows["fact_transactions"]
    dimensions.setdefault("customer", [
        dict(customer_key=k, full_name=f"Customer {k}")
        for k in sorted({r["customer_key"] for r in found if r["customer_key"] is not None})])
    dimensions.setdefault("account", [
        dict(account_key=k, account_id=f"ACC{k}") for k in sorted({r["account_key"] for r in found})])
    dimensions.setdefault("merchant", [{}])
    dimensions.setdefault("location", [{}])
    dimensions.setdefault("date", calendar(sorted(
        {r["transaction_date"] for r in found if r["transaction_date"] is not None})))
    for name, given in dimensions.items():
        table = f"dim_{name}"
        rows[table] = [{**DEFAULTS[table], **row} for row in given]

    def load(table):
        schema = TABLES[table][1]
        return spark.createDataFrame(
            [tuple(row[field.name] for field in schema) for row in rows[table]], schema)

    return Star(load)
