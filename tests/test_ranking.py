"""Ranks from counts per value against Spark's own windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskmart.functions.ranking import standings


@pytest.mark.parametrize("descending", [False, True])
def test_standings_equal_rank(spark, descending):
    rows = spark.range(2000).select(
        "id", F.when(F.col("id") % 11 != 0, F.col("id") * F.col("id") % 37).alias("score"))
    order = F.desc_nulls_last("score") if descending else F.asc_nulls_first("score")
    found = standings(rows, "score", descending=descending).withColumn(
        "plain", F.rank().over(Window.orderBy(order)))
    assert found.count() == 2000
    assert found.filter("plain <> rows_ahead + 1 or rows_total <> 2000").count() == 0


def test_standings_of_nothing(spark):
    rows = spark.range(0).select(F.col("id").alias("score"))
    assert standings(rows, "score").collect() == []


def test_one_value_in_a_third_of_the_rows(spark):
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 100).alias("score"))
    ahead = standings(rows, "score").groupBy("score").agg(
        F.min("rows_ahead").alias("low"), F.max("rows_ahead").alias("high"),
        F.count("*").alias("size")).orderBy("score").collect()
    assert all(r.low == r.high for r in ahead)
    assert [r.low for r in ahead] == [sum(x.size for x in ahead[:k]) for k in range(len(ahead))]
