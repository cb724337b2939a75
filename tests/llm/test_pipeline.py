"""The stages on small data: what each keeps, and the registered queries against SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from conftest import SCHEMA
from riskmart.llm import decontamination, near_dedup
from riskmart.llm.common import table
from riskmart.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry_point.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(names)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    names = sorted(c[0] for c in result.description)
    assert sorted(found.columns) == names
    order = [[c[0] for c in result.description].index(n) for n in names]
    expected = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr) == expected


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, before, SF), name)
        assert 0 < after.count() <= before.count(), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
            assert after.dtypes == before.dtypes
        if name == "near-duplicate removal":
            assert near_dedup.classes(after).filter("not kept").isEmpty()
        if name == "benchmark decontamination":
            assert decontamination.scan(after, table(spark, SF, "benchmark")).filter("contaminated").isEmpty()
        before = after


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(os.path.join(tmp_path, "documents.parquet"))
    table(spark, SF, "benchmark").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
