"""Table reading and shared scratch folders."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.session import scratch, shared_folder, ship_package, stored  # noqa: F401


def prepare(spark: SparkSession) -> None:
    """Ship the package to executors that lack it."""
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that no later result reads."""
    spark = df.sparkSession
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        forget_path(spark, folder)


def forget_path(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct: names inside an operator can't clash with theirs."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in needed]
    return df.select(*needed, F.struct(*(rest or [F.lit(0).alias("none")])).alias("rest_columns"))


def unpacked(df: DataFrame, columns: list[str], *needed: str) -> DataFrame:
    """The columns that packed() put away, in their order."""
    return df.select(*(F.col(c) if c in needed else F.col("rest_columns").getField(c).alias(c) for c in columns))
