"""The star schema derived from the tables of ``TESTDATA.md``.

The definitions are plain SQL that Spark and DuckDB both run, so the queries and
their oracles start from one and the same mapping (``FIXTURES.md`` explains it).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from riskmart.sources.star import TABLES, Star, conform

# The mapping of FIXTURES.md. ``MKTS`` stands for the engine's
# constructor of a timestamp without time zone.
MAPPING = {
    "ev": """
select e.*, day(ts) - 1 as di, cast('2024-01-01' as date) + cast((day(ts) - 1) * 9 + user_id % 9
  + case when user_id % 25 = 24 and (day(ts) - 1) * 9 + user_id % 9 < 121 then 121 else 0 end as int) as tdate,
 case user_id % 15 when 0 then 'A' when 5 then 'B' when 10 then 'C' when 7 then 'D' when 8 then 'E' else 'N' end as cohort from events e""",
    "ev_late": """
select *, tdate >= cast('2024-05-01' as date) as late,
 cast(case when tdate >= cast('2024-05-01' as date) and cohort = 'A' then 1 + hour(ts) % 4 else hour(ts) end as int) as hr,
 (select count(*) from part) as n_parts
 from ev""",
    "fact_transactions": """
select event_id as transaction_key, 'TXN' || lpad(cast(event_id as string), 8, '0') as transaction_id, case when user_id % 50 = 48 then user_id + 1000000000 else user_id end as customer_key,
 user_id * 2 + case when cohort = 'A' then (case when late then 1 else 0 end) when cohort = 'E' then 0 else event_id % 2 end as account_key,
 case when user_id % 50 = 49 then null when (late and cohort = 'A' and (event_id % 3 <> 0 or user_id % 30 = 0)) or (late and cohort = 'B' and event_id % 3 = 0) or (late and cohort = 'C' and event_id % 7 = 0) then event_id % cast(floor(n_parts / 25) as bigint) * 25
  when (event_id * 7) % n_parts % 25 = 0 then (event_id * 7) % n_parts + 1 else (event_id * 7) % n_parts end as merchant_key,
 case when user_id % 50 = 24 then null when (late and cohort = 'A' and event_id % 5 <> 0) or (late and cohort = 'B' and event_id % 2 = 0) or (late and cohort = 'C' and event_id % 8 = 0) then 15 + event_id % 10 when event_id % 5 = 0 then event_id % 15 else user_id % 15 end as location_key,
 year(tdate) * 10000 + month(tdate) * 100 + day(tdate) as date_key, tdate as transaction_date,
 MKTS(year(tdate), month(tdate), day(tdate), hr, minute(ts), second(ts)) as transaction_datetime, hr as transaction_hour,
 case when late and cohort = 'A' then 'Wire Transfer' else case event_id % 5 when 0 then 'Card Payment' when 1 then 'Transfer' when 2 then 'Bill Payment' when 3 then 'Cash Withdrawal' else 'Wire Transfer' end end as transaction_type,
 case event_type when 'click' then 'Mobile Banking' when 'view' then 'Web Banking' when 'purchase' then 'POS' when 'signup' then 'Branch' else 'ATM' end as channel,
 cast(cast(value as decimal(12,2)) * 20 * case when late and cohort = 'A' then 40 when late and cohort = 'B' then 6 when late and cohort = 'C' then 3 else 1 end as decimal(18,2)) as amount_usd,
 (late and cohort = 'A' and event_id % 8 <> 0) or (late and cohort = 'B' and event_id % 8 < 7) or (late and cohort = 'C' and event_id % 2 = 0) or (late and cohort = 'D' and event_id % 3 <> 0) or (late and cohort = 'E' and event_id % 2 = 0) or event_id % 97 = 0 as is_flagged,
 hr between 1 and 4 as is_off_hours,
 case when late and cohort = 'A' and event_id % 8 <> 0 then (case when event_id % 3 = 1 then 'Shell Merchant' else 'Account Takeover' end) when late and cohort = 'B' and event_id % 8 < 7 then 'Velocity' when late and cohort = 'C' and event_id % 2 = 0 then 'Geographic' when late and ((cohort = 'D' and event_id % 3 <> 0) or (cohort = 'E' and event_id % 2 = 0)) then 'Structuring' when event_id % 97 = 0 then 'Card Testing' end as fraud_type
 from ev_late""",
    "dim_customer": """
select c_custkey as customer_key, c_name as full_name, 'NATION_' || cast(c_custkey % 15 as string) as country,
 case when c_custkey % 25 < 20 then 'Verified' when c_custkey % 25 < 23 then 'Pending' else 'Expired' end as kyc_status, c_mktsegment as customer_segment,
 case when c_custkey % 2 = 0 then 'Mobile Banking' else 'Web Banking' end as preferred_channel from customer""",
    "dim_account": """
select c_custkey * 2 + k as account_key, 'ACC' || lpad(cast(c_custkey * 2 + k as string), 8, '0') as account_id, case k when 0 then 'Savings' else 'Current' end as account_type,
 case when (c_custkey * 2 + k) % 31 = 0 then 'Closed' else 'Active' end as account_status, cast(c_acctbal as decimal(18,2)) as current_balance from (select *, 0 as k from customer union all select *, 1 as k from customer) owned""",
    "dim_merchant": """
select p_partkey as merchant_key, p_name || ' ' || cast(p_partkey as string) as merchant_name, p_type as merchant_category,
 case when p_partkey % 25 = 0 then 'High' when p_size > 25 then 'Medium' else 'Low' end as risk_rating, p_partkey % 25 = 0 as is_shell_merchant,
 'NATION_' || cast(case when p_partkey % 25 = 0 then 15 + p_partkey % 8 else p_partkey % 15 end as string) as country from part""",
    "dim_location": """
select n_nationkey as location_key, n_name as country, r_name as region, n_nationkey >= 15 as is_high_risk_country from nation join region on n_regionkey = r_regionkey""",
    "dim_date": """
select distinct year(tdate) * 10000 + month(tdate) * 100 + day(tdate) as date_key, year(tdate) as year_number, month(tdate) as month_number, substr(monthname(tdate), 1, 3) as month_name,
 'Q' || cast(quarter(tdate) as string) as quarter_name, substr(dayname(tdate), 1, 3) as day_of_week, substr(dayname(tdate), 1, 3) in ('Sat', 'Sun') as is_weekend from ev""",
}

#: the definitions each table is built on, in order, and the files it starts from
READS = {
    "fact_transactions": (["ev", "ev_late"], ["events", "part"]),
    "dim_customer": ([], ["customer"]),
    "dim_account": ([], ["customer"]),
    "dim_merchant": ([], ["part"]),
    "dim_location": ([], ["nation", "region"]),
    "dim_date": (["ev"], ["events"]),
}

FILES = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string,"
              " value double, props string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double,"
                " c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int,"
            " p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def star(spark: SparkSession, sf_dir: str) -> Star:
    """The star over the Parquet files in ``sf_dir``; nothing is read yet."""

    def load(table: str) -> DataFrame:
        definitions, files = READS[table]
        shared = ",".join(f"{name} as ({MAPPING[name]})" for name in definitions)
        text = (f"with {shared} " if shared else "") + MAPPING[table]
        text = text.replace("MKTS", "make_timestamp_ntz")
        inputs = {}
        for name in files:
            inputs[name] = spark.read.schema(FILES[name]).parquet(f"{sf_dir}/{name}.parquet")
            text = re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", text)
        return conform(spark.sql(text, **inputs), TABLES[table][1])

    return Star(load)
