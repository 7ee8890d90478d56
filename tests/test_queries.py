"""Every query of the registry against its SQL, or its rows where SQL has no say."""

import datetime
import decimal
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lectern.plans import catalogue

SQL = catalogue.oracle_sql()


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating, decimal.Decimal)):
        return None if x != x else float(f"{float(x):.9g}")
    return x.isoformat() if isinstance(x, datetime.datetime) else x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    got, want = catalogue.queries()[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry_has_every_query():
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_format_context_shows_scores(spark, sf_dir):
    """The query's blocks have the score line, as those of its operator with scores."""
    from pyspark.sql import functions as F

    from lectern.operators import context

    whole = context.contexts(catalogue._ranked_hits(spark, sf_dir), with_score=True)
    assert whole.filter(~F.contains("context", F.lit("\nRelevance: "))).count() == 0
    assert {tuple(r) for r in catalogue.queries()["format_context"](spark, sf_dir).collect()} == {tuple(r) for r in whole.select("query_id", F.sha2("context", 256)).collect()}
