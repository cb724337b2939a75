"""DuckDB SQL that answers each registered query independently of Spark.

The oracles use the plain forms the operators avoid: the self join for rapid
pairs, LAG over single rows, RANK over whole tables, one aggregate per signal.
Amounts are whole cents and every rounded figure is an integer division, so no
result depends on floating-point order.
"""

from __future__ import annotations

import re

from riskmart.sources import TABLES
from riskmart.sources.testdata import MAPPING

_TX = """
select *, cast(amount_usd * 100 as hugeint) as cents,
 cast(is_flagged as int) as hit, cast(is_off_hours as int) as night
 from fact_transactions"""

_NAMED = {
    **{name: text.replace("MKTS", "make_timestamp") for name, text in MAPPING.items()},
    "tx": _TX,
    "moments": """
select avg_micro, sd, avg_micro / 1000000.0 as avg_usd from (
 select (2 * 10000 * sum(cents) + count(cents)) // (2 * count(cents)) as avg_micro,
  stddev_samp(cast(amount_usd as double)) as sd from tx)""",
}


def _units(num: str, den: str, places: int = 2) -> str:
    """``num / den`` in whole steps of 10^-places, halves away from zero."""
    return (f"(case when ({den}) = 0 then null else (case when ({num}) < 0 then -1 else 1 end)"
            f" * ((2 * {10 ** places} * abs(cast({num} as hugeint)) + ({den}))"
            f" // (2 * ({den}))) end)")


def _shown(units: str, places: int = 2) -> str:
    return f"(cast({units} as double) / {10 ** places})"


def _ratio(num: str, den: str, places: int = 2) -> str:
    return _shown(_units(num, den, places), places)


def _usd(cents: str) -> str:
    return f"(cast({cents} as double) / 100)"


def _pct(num: str, den: str) -> str:
    return _ratio(f"100 * ({num})", den)


_VOLUME = _usd("sum(cents)")
_MEAN = _ratio("sum(cents)", "100 * count(cents)")
_HITS = "cast(sum(hit) as bigint)"
_HIT_RATE = _pct("sum(hit)", "count(*)")
_HIT_CENTS = "sum(case when hit = 1 then cents else 0 end)"


def _with_ctes(body: str, given: frozenset[str] = frozenset()) -> str:
    """``body`` preceded by the shared definitions it needs, in order.

    Tables in ``given`` exist already and are not defined again.
    """
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in _NAMED.keys() - given:
            if name not in needed and re.search(rf"\b(from|join) {name}\b", text):
                needed.add(name)
                visit(_NAMED[name])

    visit(body)
    if not needed:
        return body
    shared = ",\n".join(f"{name} as ({text})" for name, text in _NAMED.items() if name in needed)
    body = body.strip()
    own = body[len("with "):] if body.lower().startswith("with ") else None
    return f"with {shared},\n{own}" if own else f"with {shared}\n{body}"


_PAIRS = f"""
with close_pairs as (
 select a.customer_key, a.cents + b.cents as both_cents,
  date_diff('minute', a.transaction_datetime, b.transaction_datetime) as gap
 from tx a join tx b using (customer_key, transaction_date)
 where b.transaction_datetime > a.transaction_datetime and a.transaction_id <> b.transaction_id
  and date_diff('minute', a.transaction_datetime, b.transaction_datetime) <= 60)
select customer_key, full_name, country, kyc_status, rapid_pair_count, min_gap_minutes,
 avg_gap_minutes, approx_volume_usd
from (select customer_key, count(*) as rapid_pair_count, min(gap) as min_gap_minutes,
  {_ratio('sum(gap)', 'count(*)', 1)} as avg_gap_minutes,
  {_ratio('sum(both_cents)', '200')} as approx_volume_usd
 from close_pairs group by customer_key having count(*) >= 5)
join dim_customer using (customer_key)
order by rapid_pair_count desc, customer_key"""

_GAPS = f"""
with steps as (
 select customer_key, cents, date_diff('minute',
  lag(transaction_datetime) over (partition by customer_key order by transaction_datetime, transaction_key),
  transaction_datetime) as gap from tx)
select customer_key, full_name, country, kyc_status, rapid_txn_count, min_gap_minutes,
 avg_gap_minutes, rapid_window_volume_usd
from (select customer_key, count(*) as rapid_txn_count, min(gap) as min_gap_minutes,
  {_ratio('sum(gap)', 'count(*)', 1)} as avg_gap_minutes, {_VOLUME} as rapid_window_volume_usd
 from steps where gap <= 60 group by customer_key having count(*) >= 5)
join dim_customer using (customer_key)
order by rapid_txn_count desc, customer_key"""

_ZSCORE = """
select transaction_id, t.customer_key, full_name, transaction_datetime, transaction_type, channel,
 cast(amount_usd as double) as amount_usd, round(avg_usd, 2) as mean_amount, round(sd, 2) as std_dev_amount,
 cast(round(cast(z as decimal(30,12)), 2) as double) as z_score,
 merchant_name, merchant_category, is_shell_merchant,
 l.country as transaction_country, is_high_risk_country
from (select tx.*, avg_usd, sd,
  cast(cents * 10000 - avg_micro as double) / 1000000 / nullif(sd, 0) as z from tx cross join moments) t
join dim_customer c using (customer_key)
join dim_merchant m using (merchant_key)
join dim_location l using (location_key)
where z > 3
order by z_score desc, t.amount_usd desc, transaction_key"""

_TAKEOVER = f"""
with early as (
 select customer_key, count(*) as n, {_units('sum(cents)', '100 * count(cents)')} as spend,
  {_units('sum(transaction_hour)', 'count(transaction_hour)', 1)} as hr
 from tx where transaction_date < date '2024-05-01' group by 1),
late as (
 select customer_key, count(*) as n, {_units('sum(cents)', '100 * count(cents)')} as spend,
  {_units('sum(transaction_hour)', 'count(transaction_hour)', 1)} as hr,
  count(distinct l.country) as places
 from tx join dim_location l using (location_key)
 where transaction_date >= date '2024-05-01' group by 1)
select customer_key, full_name, country as home_country, kyc_status, customer_segment, preferred_channel,
 {_shown('e.spend')} as early_avg_spend, {_shown('p.spend')} as late_avg_spend,
 {_ratio('p.spend', 'e.spend', 1)} as spend_multiplier,
 {_shown('e.hr', 1)} as early_avg_hour, {_shown('p.hr', 1)} as late_avg_hour,
 {_shown('abs(p.hr - e.hr)', 1)} as hour_shift,
 e.n as early_txn_count, p.n as late_txn_count, places as distinct_countries_late,
 case when e.spend = 0 or p.spend < 3 * e.spend then 'Normal Behaviour'
  when p.spend >= 5 * e.spend and abs(p.hr - e.hr) >= 40 then 'HIGH RISK — Likely Takeover'
  else 'MEDIUM RISK — Investigate' end as takeover_flag
from early e join late p using (customer_key) join dim_customer using (customer_key)
where e.n >= 3 and p.n >= 5
order by spend_multiplier desc nulls last, customer_key"""

_OFF_HOURS = f"""
select customer_key, count(*) as total_txns, cast(sum(night) as bigint) as off_hours_txns,
 {_pct('sum(night)', 'count(*)')} as off_hours_rate_pct from tx group by customer_key"""

_SPEND = f"""
select customer_key, {_ratio('ec', '100 * ea')} as early_avg_spend,
 {_ratio('lc', '100 * la')} as late_avg_spend, {_ratio('lc * ea', 'ec * la')} as spend_multiplier
from (select customer_key,
  count(cents) filter (where transaction_date < date '2024-05-01') as ea,
  count(cents) filter (where transaction_date >= date '2024-05-01') as la,
  count(*) filter (where transaction_date < date '2024-05-01') as en,
  count(*) filter (where transaction_date >= date '2024-05-01') as ln,
  sum(cents) filter (where transaction_date < date '2024-05-01') as ec,
  sum(cents) filter (where transaction_date >= date '2024-05-01') as lc
 from tx group by customer_key)
where en >= 3 and ln >= 3"""

_SHELL = f"""
select customer_key, {_pct('sum(cast(is_shell_merchant as int))', 'count(*)')} as shell_rate_pct
from tx join dim_merchant using (merchant_key) group by customer_key"""

_GEO = f"""
select customer_key,
 {_pct('sum(cast(is_high_risk_country as int))', 'count(*)')} as high_risk_country_rate_pct
from tx join dim_location using (location_key) group by customer_key"""

_SCORED_CTES = f"""
with o as ({_OFF_HOURS}), s as ({_SPEND}), sh as ({_SHELL}), g as ({_GEO}),
scored as (
 select customer_key, full_name, country, kyc_status, customer_segment, off_hours_rate_pct,
  spend_multiplier, shell_rate_pct, high_risk_country_rate_pct,
  -- fixed values: the published points, highest rung first
  case when off_hours_rate_pct >= 40 then 25 when off_hours_rate_pct >= 25 then 18
   when off_hours_rate_pct >= 10 then 10 else 3 end as score_off_hours,
  case when spend_multiplier >= 10 then 25 when spend_multiplier >= 5 then 18
   when spend_multiplier >= 2 then 10 when spend_multiplier is null then 0 else 2 end as score_spend_spike,
  case when shell_rate_pct >= 50 then 20 when shell_rate_pct >= 25 then 13
   when shell_rate_pct >= 10 then 7 else 1 end as score_shell_merchant,
  case when high_risk_country_rate_pct >= 50 then 20 when high_risk_country_rate_pct >= 20 then 13
   when high_risk_country_rate_pct >= 5 then 6 else 0 end as score_geo_risk,
  case kyc_status when 'Expired' then 10 when 'Pending' then 5 else 0 end as score_kyc
 from o join dim_customer using (customer_key) left join s using (customer_key)
  left join sh using (customer_key) left join g using (customer_key))"""

_WATCHLIST_CTES = f"""{_SCORED_CTES},
summed as (
 select *, score_off_hours + score_spend_spike + score_shell_merchant + score_geo_risk + score_kyc
  as total_risk_score from scored),
listed as (
 select *, case when total_risk_score >= 70 then 'CRITICAL' when total_risk_score >= 50 then 'HIGH'
   when total_risk_score >= 30 then 'MEDIUM' else 'LOW' end as risk_tier,
  coalesce({_ratio('100 * (rank() over (order by total_risk_score) - 1)',
                   'count(*) over () - 1', 1)}, 0) as risk_percentile
 from summed)"""

_FREEZE = f"""
select account_id, full_name, country, kyc_status, account_type, account_status,
 cast(current_balance as double) as current_balance_usd, n as total_transactions,
 hits as flagged_transactions, {_shown('rate')} as flagged_rate_pct,
 {_usd('exposed')} as flagged_exposure_usd, last_day as last_transaction_date,
 case when rate >= 7000 and exposed >= 5000000 then 'FREEZE IMMEDIATELY'
  when rate >= 5000 or exposed >= 2500000 then 'ESCALATE TO COMPLIANCE'
  when rate >= 3000 then 'ENHANCED MONITORING' else 'FLAG FOR REVIEW' end as recommended_action
from (select customer_key, account_key, count(*) as n, {_HITS} as hits, {_HIT_CENTS} as exposed,
  {_units('100 * sum(hit)', 'count(*)')} as rate, max(transaction_date) as last_day
 from tx group by 1, 2 having sum(hit) >= 10)
join dim_customer using (customer_key) join dim_account using (account_key)
order by exposed desc, account_key, customer_key"""


def _trend(columns: str, keys: str, source: str, mom: str) -> str:
    """Monthly totals followed by the change against the row before."""
    return f"""
with months as (
 select year_number, month_number, month_name, quarter_name, count(*) as n,
  count(distinct customer_key) as people, sum(cents) as cents, count(cents) as amounts
 from {source} join dim_date using (date_key) group by 1, 2, 3, 4),
steps as (select *, lag(cents) over (order by year_number, month_number) as before from months)
select {keys}, {columns}, {_usd('cents - before')} as {mom},
 {_pct('cents - before', 'before')} as mom_change_pct
from steps"""


_BODIES = {
    "f1_flagged_base": """
select * replace (cast(amount_usd as double) as amount_usd, cast(date_key as integer) as date_key,
  cast(merchant_key as varchar) as merchant_key, cast(location_key as varchar) as location_key),
 cast(is_flagged as int) as is_flagged_int, cast(is_off_hours as int) as is_off_hours_int
from fact_transactions""",
    "f2_portfolio_stats": f"""
select count(*) as total_rows, {_ratio('sum(cents)', '100 * count(cents)', 6)} as mean_amount,
 round(stddev_samp(cast(amount_usd as double)), 2) as std_dev_amount, {_HITS} as total_flagged from tx""",
    "f3_date_spine": """
select * replace (cast(date_key as integer) as date_key, cast(year_number as integer) as year_number,
 cast(month_number as integer) as month_number) from dim_date""",
    "q1_1_portfolio_summary": f"""
select count(*) as total_transaction_lines, count(distinct transaction_id) as total_distinct_transactions,
 count(distinct customer_key) as total_customers, count(distinct account_key) as total_accounts,
 {_VOLUME} as total_volume_usd, {_MEAN} as avg_transaction_amount,
 {_usd('min(cents)')} as min_transaction_amount, {_usd('max(cents)')} as max_transaction_amount,
 round(stddev_samp(cast(amount_usd as double)), 2) as std_dev_amount from tx""",
    "q1_2_channel_mix": f"""
select channel, count(*) as transaction_count, count(distinct customer_key) as unique_customers,
 {_VOLUME} as total_volume_usd, {_MEAN} as avg_transaction_amount,
 {_pct('count(*)', '(select count(*) from tx)')} as transaction_pct,
 {_pct('sum(cents)', '(select sum(cents) from tx)')} as volume_pct
from tx group by channel""",
    "q1_3_monthly_trend": _trend(
        f"n as total_transactions, people as active_customers, {_usd('cents')} as total_volume_usd,"
        f" {_ratio('cents', '100 * amounts')} as avg_transaction_amount",
        "cast(year_number as integer) as year_number, cast(month_number as integer) as month_number,"
        " month_name, quarter_name", "tx", "mom_volume_change"),
    "q1_4_kyc_distribution": f"""
select kyc_status, count(distinct c.customer_key) as customer_count,
 count(transaction_key) as transaction_count, {_VOLUME} as total_volume_usd,
 {_ratio('sum(cents)', '100 * count(cents)')} as avg_transaction_amount,
 {_pct('count(distinct c.customer_key)', '(select count(distinct customer_key) from dim_customer)')}
  as pct_of_customers
from dim_customer c left join tx on tx.customer_key = c.customer_key group by kyc_status""",
    "q2_1_time_window": f"""
with labelled as (
 select *, case when transaction_hour between 1 and 4 then 'Off-Hours (1AM-4AM)'
  when transaction_hour between 8 and 18 then 'Business Hours (8AM-6PM)'
  else 'Transition Hours' end as time_window from tx)
select time_window, count(*) as total_transactions, count(distinct customer_key) as unique_customers,
 {_VOLUME} as total_volume_usd, {_MEAN} as avg_transaction_amount,
 {_pct('count(*)', '(select count(*) from tx)')} as pct_of_transactions
from labelled group by time_window""",
    "q2_2a_rapid_pairs": f"{_PAIRS} limit 50",
    "q2_2a_rapid_pairs_all": _PAIRS,
    "q2_2b_rapid_gaps": f"{_GAPS} limit 50",
    "q2_2b_rapid_gaps_all": _GAPS,
    "q2_3_zscore_outliers": f"{_ZSCORE} limit 100",
    "q2_3_zscore_outliers_all": _ZSCORE,
    "q2_4_daily_spikes": f"""
with days as (
 select transaction_date, day_of_week, is_weekend, count(*) as transaction_count, sum(cents) as cents
 from tx join dim_date using (date_key) group by 1, 2, 3),
rolled as (
 select *, sum(cents) over last_rows as sum7, count(*) over last_rows as n7 from days
 window last_rows as (order by transaction_date rows between 6 preceding and current row)),
rated as (
 select *, {_units('cents * n7', 'sum7')} as spike from rolled)
select transaction_date, day_of_week, is_weekend, transaction_count, {_usd('cents')} as daily_volume_usd,
 {_ratio('sum7', '100 * n7')} as rolling_7d_avg_usd, {_shown('spike')} as spike_ratio,
 case when spike >= 200 then 'SPIKE DETECTED' when spike >= 150 then 'Elevated' else 'Normal' end as spike_flag
from rated""",
    "q3_1_account_takeover": f"{_TAKEOVER} limit 100",
    "q3_1_account_takeover_all": _TAKEOVER,
    "q3_2_geo_anomaly": f"""
select customer_key, full_name, c.country as registered_country, l.country as transaction_country,
 is_high_risk_country, count(*) as foreign_transaction_count, {_VOLUME} as foreign_volume_usd,
 {_MEAN} as avg_foreign_txn_value, min(transaction_date) as first_foreign_txn,
 max(transaction_date) as last_foreign_txn
from tx join dim_customer c using (customer_key) join dim_location l using (location_key)
where is_high_risk_country and l.country <> c.country
group by 1, 2, 3, 4, 5 having count(*) >= 3""",
    "q4_1_merchant_risk": f"""
select merchant_key, merchant_name, merchant_category, risk_rating, is_shell_merchant,
 country as merchant_country, count(*) as total_transactions,
 count(distinct customer_key) as unique_customers, {_VOLUME} as total_volume_usd,
 {_MEAN} as avg_transaction_value, {_HITS} as flagged_count, {_HIT_RATE} as flagged_rate_pct,
 rank() over (order by sum(hit) desc) as risk_rank
from tx join dim_merchant using (merchant_key) group by 1, 2, 3, 4, 5, 6""",
    "q4_2_shell_flows": f"""
select merchant_name, merchant_category, m.country as merchant_country,
 l.country as transaction_origin_country, is_high_risk_country, channel,
 count(*) as transaction_count, count(distinct customer_key) as unique_customers,
 {_VOLUME} as total_volume_usd, {_MEAN} as avg_transaction_value
from tx join dim_merchant m using (merchant_key) join dim_location l using (location_key)
where is_shell_merchant group by 1, 2, 3, 4, 5, 6""",
    "q4_3_channel_risk": f"""
select channel, count(*) as total_transactions, {_HITS} as flagged_count,
 {_HIT_RATE} as flagged_rate_pct, {_VOLUME} as total_volume_usd,
 {_usd(_HIT_CENTS)} as flagged_volume_usd, {_pct(_HIT_CENTS, 'sum(cents)')} as pct_volume_flagged
from tx group by channel""",
    "q4_4_country_exposure": f"""
with located as (select * from tx join dim_location using (location_key))
select country, is_high_risk_country, count(*) as transaction_count,
 count(distinct customer_key) as unique_customers, {_VOLUME} as total_volume_usd,
 {_HITS} as flagged_count, {_HIT_RATE} as flagged_rate_pct,
 {_pct('sum(cents)', '(select sum(cents) from located)')} as pct_of_total_volume
from located group by country, is_high_risk_country""",
    "s5_off_hours_signal": _OFF_HOURS,
    "s5_spend_spike_signal": _SPEND,
    "s5_shell_signal": _SHELL,
    "s5_geo_signal": _GEO,
    "s5_scored": f"{_SCORED_CTES} select * from scored",
    "q5_1_watchlist": f"{_WATCHLIST_CTES} select * from listed",
    "q5_2_tier_summary": f"""{_WATCHLIST_CTES}
select risk_tier, count(*) as customer_count,
 {_pct('count(*)', '(select count(*) from listed)')} as pct_of_customers,
 {_ratio('sum(total_risk_score)', 'count(*)', 1)} as avg_score,
 min(total_risk_score) as min_score, max(total_risk_score) as max_score
from listed group by risk_tier""",
    "q6_1_exec_summary": f"""
select count(*) as total_transactions, {_HITS} as flagged_transactions, {_HIT_RATE} as fraud_rate_pct,
 {_VOLUME} as total_portfolio_volume_usd, {_usd(_HIT_CENTS)} as estimated_fraud_exposure_usd,
 {_pct(_HIT_CENTS, 'sum(cents)')} as exposure_as_pct_of_portfolio from tx""",
    "q6_2_exposure_by_type": f"""
select fraud_type, count(*) as flagged_transactions, count(distinct customer_key) as customers_affected,
 {_VOLUME} as estimated_exposure_usd, {_MEAN} as avg_flagged_txn_value,
 {_pct('sum(cents)', '(select sum(cents) from tx where is_flagged)')} as pct_of_total_exposure
from tx where is_flagged group by fraud_type""",
    "q6_3_fraud_trend": _trend(
        f"n as flagged_transactions, people as unique_affected_customers,"
        f" {_usd('cents')} as monthly_exposure_usd",
        "month_name, quarter_name", "(select * from tx where is_flagged)",
        "mom_exposure_change_usd"),
    "q6_4_freeze_list": f"{_FREEZE} limit 25",
    "q6_4_freeze_list_all": _FREEZE,
    "q6_5_kpi_report": f"""
with facts as (
 select count(*) as n, {_units('100 * sum(hit)', 'count(*)')} as rate,
  {_units(_HIT_CENTS, '100', 0)} as dollars from tx),
frozen as (
 select account_key from tx group by account_key
 having 100 * sum(hit) >= 70 * count(*) and {_HIT_CENTS} >= 5000000)
select 'TOTAL TRANSACTIONS REVIEWED' as metric, cast(n as varchar) as value from facts
union all select 'TOTAL FRAUD EXPOSURE (USD)', '$' || format('{{:,}}', cast(dollars as bigint)) from facts
union all select 'FRAUD RATE (%)', (rate // 100) || '.' || lpad(cast(rate % 100 as varchar), 2, '0') || '%' from facts
union all (select 'HIGHEST RISK CHANNEL', channel from tx where is_flagged
 group by channel order by count(*) desc, channel limit 1)
union all (select 'HIGHEST RISK FRAUD TYPE', fraud_type from tx where is_flagged
 group by fraud_type order by sum(cents) desc, fraud_type limit 1)
union all select 'ACCOUNTS RECOMMENDED FOR FREEZE', cast(count(*) as varchar) from frozen""",
}

#: complete statements by the name of the query they check
ORACLES: dict[str, str] = {name: _with_ctes(body) for name, body in _BODIES.items()}

#: the same over star tables that exist under their own names
STAR_ORACLES: dict[str, str] = {
    name: _with_ctes(body, frozenset(TABLES)) for name, body in _BODIES.items()}
