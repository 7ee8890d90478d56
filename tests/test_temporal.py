import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import temporal


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sides():
    rng = np.random.default_rng(3)
    # one key has two thirds of the rows, times repeat and meet
    key = lambda n: rng.choice(["hot"] * 8 + ["a", "b", "c", None], n)
    left = pd.DataFrame({"k": key(600), "t": rng.integers(0, 500, 600).astype(float), "id": range(600)})
    right = pd.DataFrame({"k": key(400), "u": rng.integers(0, 500, 400).astype(float), "v": range(400)})
    left.loc[::50, "t"] = np.nan
    right.loc[::40, "u"] = np.nan
    return left, right


def plain_asof(left, right, forward, exact, tolerance):
    out = {}
    for k, t, i in left.itertuples(index=False):
        best = None
        for k2, u, v in right.itertuples(index=False):
            if k is None or k != k2 or np.isnan(t) or np.isnan(u):
                continue
            gap = u - t if forward else t - u
            if gap < 0 or (gap == 0 and not exact):
                continue
            if best is None or gap < best[0] or (gap == best[0] and v > best[1]):
                best = (gap, v)
        out[i] = best[1] if best and (tolerance is None or best[0] <= tolerance) else None
    return out


@pytest.mark.parametrize("slice_rows", [10_000, 70])
@pytest.mark.parametrize(("forward", "exact", "tolerance"), [(False, True, None), (False, False, 5.0), (True, True, 3.0), (True, False, None)])
def test_asof_equals_plain(spark, sides, slice_rows, forward, exact, tolerance):
    left, right = sides
    a = spark.createDataFrame(left.astype(object).where(left.notna(), None), "k string, t double, id long")
    b = spark.createDataFrame(right.astype(object).where(right.notna(), None), "k string, u double, v long")
    joined = temporal.asof_join(a, b, ["k"], "t", "u", ["v"], tolerance, "forward" if forward else "backward", exact, tie=["v"], slice_rows=slice_rows)
    got = {r.id: r.v for r in joined.collect()}
    assert got == plain_asof(left, right, forward, exact, tolerance)
    text = plan(joined)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_asof_cuts_a_hot_key(spark):
    """With slices, no window holds more than a few times slice_rows of a key that has all rows."""
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("t"), "id")
    few = rows.filter("id % 4000 = 7").select("k", F.col("t").alias("u"), F.col("id").alias("v"))
    joined = temporal.asof_join(rows, few, ["k"], "t", "u", ["v"], slice_rows=1000)
    got = {r.id: r.v for r in joined.collect()}
    assert got == {i: (i - 7) // 4000 * 4000 + 7 if i >= 7 else None for i in range(20_000)}
    assert "_slice" in plan(joined)


def test_asof_times_and_clashing_names(spark):
    day = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([(1, day + dt.timedelta(seconds=10), "x")], "k int, t timestamp, v string")
    b = spark.createDataFrame([(1, day + dt.timedelta(seconds=4), "y"), (1, day, "z")], "k int, u timestamp, v string")
    r = temporal.asof_join(a, b, ["k"], "t", "u", ["v", "u"], F.expr("INTERVAL 7 SECONDS")).first()
    assert (r.v, r.v_right, r.u) == ("x", "y", day + dt.timedelta(seconds=4))
    assert temporal.asof_join(a, b, ["k"], "t", "u", ["u"], F.expr("INTERVAL 5 SECONDS")).first().u is None
    assert temporal.asof_join(a.limit(0), b, ["k"], "t", "u", ["u"]).count() == 0
    assert temporal.asof_join(a, b.limit(0), ["k"], "t", "u", ["u"]).first().u is None
    with pytest.raises(ValueError):
        temporal.asof_join(a, b, ["k"], "t", "u", ["u"], direction="sideways")


@pytest.fixture(scope="module")
def spans():
    rng = np.random.default_rng(9)

    def made(n, name):
        start = rng.integers(-300, 300, n) / 2
        size = rng.choice([0, 0, 0.5, 1, 2, 3, 7, 40, 250], n)
        df = pd.DataFrame({"k": rng.choice(["hot"] * 5 + ["a", "b"], n), f"{name}a": start, f"{name}b": start + size, f"{name}": range(n)})
        df.loc[::30, f"{name}b"] = None
        df.loc[1::30, f"{name}b"] = df.loc[1::30, f"{name}a"] - 1
        return df

    return made(300, "l"), made(250, "r")


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("on", [["k"], []])
@pytest.mark.parametrize("width", [0.7, 1.0, 1000.0])
def test_interval_join_equals_sql(spark, spans, closed, on, width):
    left, right = spans
    a, b = (spark.createDataFrame(x.astype(object).where(x.notna(), None), ", ".join(f"{c} {'string' if c == 'k' else 'long' if len(c) == 1 else 'double'}" for c in x.columns)) for x in (left, right))
    if not on:
        b = b.withColumnRenamed("k", "k2")
    joined = temporal.interval_join(a, b, ("la", "lb"), ("ra", "rb"), on, width, closed)
    c = "<=" if closed else "<"
    proper = "la <= lb AND ra <= rb" if closed else "la < lb AND ra < rb"
    want = duckdb.sql(f"SELECT l, r FROM \"left\" JOIN \"right\" ON {'\"left\".k = \"right\".k AND ' if on else ''} la {c} rb AND ra {c} lb AND {proper}").fetchall()
    got = [(r.l, r.r) for r in joined.collect()]
    assert sorted(got) == sorted(want) and len(set(got)) == len(got)
    assert "NestedLoop" not in plan(joined) and "Cartesian" not in plan(joined)


def test_long_intervals_stay_few_rows(spark):
    """An interval of a million widths lies in two buckets of its level, and meets short ones through their shadows."""
    a = spark.createDataFrame([(0.0, 1e6, 1)], "la double, lb double, l long")
    b = spark.range(1000).select(F.col("id").cast("double").alias("ra"), F.col("id").cast("double").alias("rb"), F.col("id").alias("r"))
    assert temporal.interval_join(a, b, ("la", "lb"), ("ra", "rb")).count() == 1000
    assert temporal.interval_join(b, a, ("ra", "rb"), ("la", "lb")).count() == 1000
    assert temporal.range_join(b.select(F.col("ra").alias("p"), "r"), a, "p", ("la", "lb")).count() == 1000
    assert temporal.interval_join(a.limit(0), b, ("la", "lb"), ("ra", "rb")).count() == 0
    assert temporal.interval_join(a, b.limit(0), ("la", "lb"), ("ra", "rb")).count() == 0


def test_band_join(spark):
    a = spark.createDataFrame([(i, float(x)) for i, x in enumerate([-3, 0, 0.4, 1, 2.5, 9])] + [(99, None)], "l long, x double")
    b = spark.createDataFrame([(i, float(x)) for i, x in enumerate([-3.5, -0.5, 1, 1.5, 2, 10])] + [(99, None)], "r long, y double")
    joined = temporal.band_join(a, b, "x", "y", 1.0)
    want = {(r.l, s.r) for r in a.collect() for s in b.collect() if r.x is not None and s.y is not None and abs(r.x - s.y) <= 1}
    got = [(r.l, r.r) for r in joined.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "NestedLoop" not in plan(joined)
    with pytest.raises(ValueError):
        temporal.band_join(a, b, "x", "y", 0)


@pytest.mark.parametrize("closed", [True, False])
def test_full_buckets_are_cut_into_tiles(spark, spans, monkeypatch, closed):
    """Pairs of full buckets meet once however they are cut; rows that are equal in everything too."""
    monkeypatch.setattr(temporal, "TILE", 4)
    left, right = spans
    a, b = (spark.createDataFrame(x.astype(object).where(x.notna(), None), ", ".join(f"{c} {'string' if c == 'k' else 'long' if len(c) == 1 else 'double'}" for c in x.columns)) for x in (left, right))
    joined = temporal.interval_join(a, b, ("la", "lb"), ("ra", "rb"), ["k"], 1000.0, closed)
    c = "<=" if closed else "<"
    proper = "la <= lb AND ra <= rb" if closed else "la < lb AND ra < rb"
    want = duckdb.sql(f'SELECT l, r FROM "left" JOIN "right" ON "left".k = "right".k AND la {c} rb AND ra {c} lb AND {proper}').fetchall()
    assert sorted((r.l, r.r) for r in joined.collect()) == sorted(want)
    assert "_tl_at" in plan(joined) and "NestedLoop" not in plan(joined)
    same = spark.range(50).select(F.lit(1.0).alias("x"))
    assert temporal.band_join(same, same.select(F.col("x").alias("y")), "x", "y", 1.0).count() == 2500


def test_range_of_prices_is_many_tasks(spark, tmp_path):
    """All prices lie in a few buckets: their pairs are dealt to many tasks, none with more than a few times its share."""
    from lectern.plans import catalogue

    spark.range(60_000).selectExpr("id AS p_partkey", "CAST(900 + id % 100 AS DOUBLE) AS p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(400).selectExpr("id AS s_suppkey", "CAST(880 + id % 130 AS DOUBLE) AS s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))
    pairs = catalogue.queries()["range_of_prices"](spark, str(tmp_path))
    per = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    want = sum(600 for s in range(400) for p in range(900, 1000) if 880 + s % 130 <= p <= 905 + s % 130)
    assert sum(per) == want and len(per) >= 4 and max(per) < 0.6 * want
