"""Connected components by alternating star contractions, with the edges kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import forget, stored


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r["n"], int(r["h"])


def _point_to_least(edges: DataFrame, only_smaller: bool) -> DataFrame:
    """Large star (each node points its larger neighbours at its least one) or small star (its smaller neighbours and itself)."""
    around = edges if only_smaller else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    joined = around.join(least, "a")
    if only_smaller:
        new = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    else:
        new = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return new.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of edges (a, b); the label is the least node of its component.

    Each round halves path lengths at least; rounds stop when the edges no longer change.
    """
    down = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    kept = stored(down, "edges")
    state = _state(kept)
    while state[0]:
        last, before = kept, state
        kept = stored(_point_to_least(_point_to_least(kept, False), True), "edges")
        state = _state(kept)
        forget(last)
        if state == before:
            break
    return kept.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(kept.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
