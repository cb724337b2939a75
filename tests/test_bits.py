"""Distinct counts by words of bits, and the portfolio totals that carry them."""

import random

import pytest
from pyspark.sql import functions as F

from riskmart.functions.bits import key_bits, key_word
from riskmart.operators.baseline import portfolio_summary
from riskmart.operators.foundation import flagged_base, portfolio_stats
from stars import make_star

LEAST, MOST = -2 ** 63, 2 ** 63 - 1


@pytest.mark.parametrize("keys", [
    [], [None], [0], [0, None, 0], [-1, -64, -65, 63, 64, 0], [LEAST, MOST, LEAST + 1, MOST - 1, None],
    [random.Random(1).randrange(-500, 500) for _ in range(2000)],
    [random.Random(2).randrange(LEAST, MOST) for _ in range(500)] * 2])
def test_words_count_distinct_keys(spark, keys):
    frame = spark.createDataFrame([(k,) for k in keys], "key long")
    words = frame.groupBy(key_word(F.col("key")).alias("word")).agg(key_bits(F.col("key")).alias("bits"))
    found = words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))).head()[0]
    assert found == len(set(keys) - {None})


def test_dense_keys_share_words(spark):
    frame = spark.range(100_000).withColumnRenamed("id", "key")
    assert frame.groupBy(key_word(F.col("key"))).agg(key_bits(F.col("key"))).count() == 100_000 // 64 + 1


def test_summary_with_one_key_for_a_third_of_the_rows(spark):
    rng = random.Random(4)
    rows = [dict(customer_key=1 if i % 3 == 0 else rng.choice([None, *range(-70, 70)]),
                 account_key=rng.randrange(10 ** 9), transaction_id=f"T{rng.randrange(250)}",
                 amount_usd=rng.choice([None, 1, 2.5])) for i in range(600)]
    star = make_star(spark, rows)
    row = portfolio_summary(flagged_base(star.fact), portfolio_stats(star.fact)).head()
    amounts = [r["amount_usd"] for r in rows if r["amount_usd"] is not None]
    assert row.total_transaction_lines == 600
    assert row.total_customers == len({r["customer_key"] for r in rows} - {None})
    assert row.total_accounts == len({r["account_key"] for r in rows})
    assert row.total_distinct_transactions == len({r["transaction_id"] for r in rows})
    assert float(row.total_volume_usd) == sum(amounts)


def test_summary_of_no_rows(spark):
    star = make_star(spark, [])
    row = portfolio_summary(flagged_base(star.fact), portfolio_stats(star.fact)).head()
    assert (row.total_transaction_lines, row.total_customers, row.total_accounts) == (0, 0, 0)
    assert row.total_volume_usd is None and row.avg_transaction_amount is None
