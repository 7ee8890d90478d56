"""Samples of questions: simple, and stratified with or without a refill. Order is by a seeded hash, so results repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def _order(key: str, seed: int):
    return F.xxhash64(F.lit(seed), key)


def simple(df: DataFrame, n: int, key: str = "id", seed: int = 0) -> DataFrame:
    return df.orderBy(_order(key, seed), key).limit(n)


def stratified(df: DataFrame, n: int, by: str = "question_type", key: str = "id", seed: int = 0, refill: bool = True) -> DataFrame:
    """n // groups of each group; with refill the rest comes from what is left."""
    groups = max(1, df.select(by).distinct().count())
    w = Window.partitionBy(by).orderBy(_order(key, seed), key)
    ranked = df.withColumn("_n", F.row_number().over(w)).withColumn("_late", (F.col("_n") > n // groups).cast("int"))
    if not refill:
        return ranked.filter("_late = 0").drop("_n", "_late").limit(n)
    return ranked.orderBy("_late", _order(key, seed), key).limit(n).drop("_n", "_late")
