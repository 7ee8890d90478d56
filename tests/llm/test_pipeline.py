import os

import duckdb
import pytest

import corpus_pipeline
from lectern.llm import registry
from tests.test_queries import rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf_dir}/{t}'")
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, last = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == names, name
        assert 0 < docs.count() <= last
        last = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == last
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == last


def test_stages_take_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), "test-stage")
        assert docs.count() == 0
