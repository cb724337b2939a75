"""The mapping keeps every row of the tables it starts from."""

import pytest

from riskmart.sources import testdata


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_no_row_is_left_out(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    star = testdata.star(spark, folder)

    def rows(table):
        return spark.read.parquet(f"{folder}/{table}.parquet").count()

    assert star.fact.count() == rows("events")
    assert star.customer.count() == rows("customer")
    assert star.account.count() == 2 * rows("customer")
    assert star.merchant.count() == rows("part")
    assert star.location.count() == rows("nation")


def test_facts_name_shells_and_other_merchants_of_the_dimension(spark):
    star = testdata.star(spark, "/root/testdata/sf0.01")
    known = star.fact.filter("merchant_key is not null")
    assert known.join(star.merchant, "merchant_key", "left_anti").isEmpty()
    by_kind = {r.is_shell_merchant: r["count"] for r in
               known.join(star.merchant, "merchant_key").groupBy("is_shell_merchant").count().collect()}
    assert set(by_kind) == {True, False}
    assert known.select("merchant_key").distinct().count() > 1000
