"""Explicit schemas of the star: one transaction fact and five dimensions.

Contract: the ``*_key`` of a dimension is its primary key, and amounts have two
decimal places. Nothing is inferred when a table is read.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(*field) for field in fields])


FACT_TRANSACTIONS = _table(
    ("transaction_key", T.LongType()),
    ("transaction_id", T.StringType()),
    ("customer_key", T.LongType()),
    ("account_key", T.LongType()),
    ("merchant_key", T.LongType()),
    ("location_key", T.LongType()),
    ("date_key", T.IntegerType()),
    ("transaction_date", T.DateType()),
    ("transaction_datetime", T.TimestampNTZType()),
    ("transaction_hour", T.IntegerType()),
    ("transaction_type", T.StringType()),
    ("channel", T.StringType()),
    ("amount_usd", MONEY),
    ("is_flagged", T.BooleanType()),
    ("is_off_hours", T.BooleanType()),
    ("fraud_type", T.StringType()),
)

DIM_CUSTOMER = _table(
    ("customer_key", T.LongType()),
    ("full_name", T.StringType()),
    ("country", T.StringType()),
    ("kyc_status", T.StringType()),
    ("customer_segment", T.StringType()),
    ("preferred_channel", T.StringType()),
)

DIM_ACCOUNT = _table(
    ("account_key", T.LongType()),
    ("account_id", T.StringType()),
    ("account_type", T.StringType()),
    ("account_status", T.StringType()),
    ("current_balance", MONEY),
)

DIM_MERCHANT = _table(
    ("merchant_key", T.LongType()),
    ("merchant_name", T.StringType()),
    ("merchant_category", T.StringType()),
    ("risk_rating", T.StringType()),
    ("is_shell_merchant", T.BooleanType()),
    ("country", T.StringType()),
)

DIM_LOCATION = _table(
    ("location_key", T.LongType()),
    ("country", T.StringType()),
    ("region", T.StringType()),
    ("is_high_risk_country", T.BooleanType()),
)

DIM_DATE = _table(
    ("date_key", T.IntegerType()),
    ("year_number", T.IntegerType()),
    ("month_number", T.IntegerType()),
    ("month_name", T.StringType()),
    ("quarter_name", T.StringType()),
    ("day_of_week", T.StringType()),
    ("is_weekend", T.BooleanType()),
)
