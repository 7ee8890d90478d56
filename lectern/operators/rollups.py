"""Approximate aggregates that roll up: sketches by hour and group, stored once and merged into longer spans without reading rows again.

A rollup row holds exact counts and sums beside three mergeable sketches: distinct users (HyperLogLog), quantiles of the values (KLL) and the most
frequent items (a counter table of fixed size). All are Spark's own aggregates: each task sketches its rows, so a group that holds most rows is a row per task
before the shuffle. Errors, for the default sizes: distinct counts within 1.7 % (one standard error), quantile ranks within 1.65 % (99 times in 100), item
counts exact while a group has at most `items` different items and never too large by more than rows / items beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: log2 of HyperLogLog's buckets, KLL's k, counters of frequent items.
LOG_BUCKETS, K, ITEMS = 12, 200, 1000
#: One standard error of distinct counts; rank error of quantiles.
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (LOG_BUCKETS / 2), 0.0165


def hourly(events: DataFrame, groups: list[str], time: str = "ts", user: str = "user_id", value: str = "value", item: str = "user_id", log_buckets: int = LOG_BUCKETS, k: int = K, items: int = ITEMS) -> DataFrame:
    """start, groups, n, total, least, most, users, values, items: a rollup row for each hour and group that has rows."""
    hour = F.date_trunc("hour", F.col(time)).alias("start")
    return events.groupBy(hour, *groups).agg(
        F.count("*").alias("n"),
        F.sum(value).alias("total"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.hll_sketch_agg(user, log_buckets).alias("users"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("values"),
        F.expr(f"approx_top_k_accumulate({item}, {items})").alias("items"),
    )


def rolled_up(rollup: DataFrame, span: str | None, groups: list[str], items: int = ITEMS) -> DataFrame:
    """The rollup of longer spans ("day", "week", "month"; all time for None) and of fewer groups, from rollup rows alone."""
    start = [F.date_trunc(span, F.col("start")).alias("start")] if span else []
    return rollup.groupBy(*start, *groups).agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.hll_union_agg("users").alias("users"),
        F.kll_merge_agg_double("values").alias("values"),
        F.expr(f"approx_top_k_combine(items, {items})").alias("items"),
    )


def distinct(sketch: Column | str = "users") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(p: float, sketch: Column | str = "values") -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(p))


def rank(value: float, sketch: Column | str = "values") -> Column:
    """Share of the values that are at most this one."""
    return F.kll_sketch_get_rank_double(sketch, F.lit(float(value)))


def frequent(k: int, sketch: str = "items") -> Column:
    """The k most frequent items with their counts, array<struct<item, count>>."""
    return F.expr(f"approx_top_k_estimate({sketch}, {k})")
