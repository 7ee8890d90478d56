import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import rollups


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(4)
    n = 60_000
    df = pd.DataFrame({
        "ts": pd.Timestamp("2024-03-01") + pd.to_timedelta(rng.integers(0, 3 * 86400, n), unit="s"),
        # a third of the rows is one user's, one type has most rows
        "user_id": np.where(rng.random(n) < 0.33, 7, rng.integers(0, 9000, n)),
        "event_type": rng.choice(["hot", "rare"], n, p=[0.95, 0.05]),
        "value": rng.lognormal(size=n),
    })
    return spark.createDataFrame(df).repartition(4).cache()


def test_rolled_up_within_bounds(events):
    """Merged from 72 hours, each estimate keeps the bounds that the module states, against exact answers."""
    hours = rollups.hourly(events, ["event_type"])
    for row in rollups.rolled_up(hours, "day", ["event_type"]).select("start", "event_type", "n", "least", "most", rollups.distinct().alias("users"), rollups.quantile(0.9).alias("q"), rollups.rank(1.0).alias("r"), rollups.frequent(1).alias("top")).collect():
        part = events.filter((F.date_trunc("day", "ts") == F.lit(row.start)) & (F.col("event_type") == row.event_type)).toPandas()
        assert (row.n, row.least, row.most) == (len(part), part.value.min(), part.value.max())
        assert abs(row.users - part.user_id.nunique()) <= 3 * rollups.DISTINCT_ERROR * part.user_id.nunique()
        assert abs((part.value <= row.q).mean() - 0.9) <= 2 * rollups.RANK_ERROR
        assert abs(row.r - (part.value <= 1.0).mean()) <= 2 * rollups.RANK_ERROR
        count = (part.user_id == 7).sum()
        assert row.top[0]["item"] == 7 and count <= row.top[0]["count"] <= count + len(part) / rollups.ITEMS


def test_merged_equals_whole(events):
    """Rolling up hours, then days, gives what one sketch of all rows gives: distinct counts to the unit, exact columns to the bit."""
    hours = rollups.hourly(events, ["event_type"])
    whole = events.groupBy().agg(F.count("*").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id", rollups.LOG_BUCKETS)).alias("users"), F.min("value").alias("least")).first()
    for rollup in (rollups.rolled_up(hours, None, []), rollups.rolled_up(rollups.rolled_up(hours, "day", ["event_type"]), None, [])):
        got = rollup.select("n", rollups.distinct().alias("users"), "least").first()
        assert (got.n, got.least) == (whole.n, whole.least) and abs(got.users - whole.users) <= 0.01 * whole.users


def test_stored_rollups_serve_without_rows(events, tmp_path):
    """Written once, read back and rolled up: the plan reads the rollup only, and new hours are appended, not merged in place."""
    spark = events.sparkSession
    cut = F.lit("2024-03-02").cast("timestamp")
    rollups.hourly(events.filter(F.col("ts") < cut), ["event_type"]).write.parquet(str(tmp_path / "r"))
    rollups.hourly(events.filter(F.col("ts") >= cut), ["event_type"]).write.mode("append").parquet(str(tmp_path / "r"))
    stored = rollups.rolled_up(spark.read.parquet(str(tmp_path / "r")), None, ["event_type"])
    assert {r.event_type: r.n for r in stored.collect()} == {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}


def test_sketches_are_made_before_the_shuffle(events):
    plan = rollups.hourly(events, ["event_type"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_hll_sketch_agg" in plan and "partial_kll_sketch_agg" in plan and "partial_approx_top_k" in plan


def test_nothing(events):
    assert rollups.hourly(events.limit(0), ["event_type"]).count() == 0
    nulls = events.limit(3).withColumns({"user_id": F.lit(None).cast("long"), "value": F.lit(None).cast("double")})
    r = rollups.rolled_up(rollups.hourly(nulls, []), None, []).select("n", "total", rollups.distinct().alias("u")).first()
    assert (r.n, r.total, r.u) == (3, None, 0)


def test_daily_query_with_more_users_than_counters(spark, tmp_path):
    """The most frequent user of a day is counted right where a sketch has too few counters for all users."""
    from lectern.plans import catalogue

    # 6,000 users of a day with four rows each, one with five
    users = np.append(np.tile(np.arange(6000), 4), 17)
    df = pd.DataFrame({"event_id": np.arange(len(users)), "ts": pd.Timestamp("2024-03-01") + pd.to_timedelta(np.arange(len(users)) * 3, unit="s"), "user_id": users, "event_type": "view", "value": 1.0})
    spark.createDataFrame(df).write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r[c] for c in ("day", "n", "top_count", "n_users", "users_hold", "median_holds")) for r in catalogue.queries()["daily_rollup"](spark, str(tmp_path)).collect()] == [("2024-03-01", 24001, 5, 6000, True, True)]
