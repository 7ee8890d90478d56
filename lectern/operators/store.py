"""The chunk store: plain Parquet by version and collection, partitioned by department, and its manifest."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from lectern.operators.vectors import embed
from lectern.sources.readers import delete_path, path_exists, subfolders


class ChunkStore:
    """A Parquet folder of chunks, partitioned by department. One writer at a time.

    The chunks are in a generation: a folder g1, g2, ... in the store's. Chunks are added to the latest whole one; a delete writes the next
    and drops the one before, so a crash at any point leaves a whole generation to read, the one before or the one after.
    """

    def __init__(self, spark: SparkSession, root: str, version: str = "v1", collection: str = "chunks"):
        self.spark, self.path = spark, f"{root}/{version}/{collection}"

    def _generation(self) -> int:
        """The latest whole generation, 0 without any."""
        numbers = [int(n[1:]) for n in subfolders(self.spark, self.path) if n[:1] == "g" and n[1:].isdigit()]
        return max((n for n in numbers if path_exists(self.spark, f"{self.path}/g{n}/_SUCCESS")), default=0)

    def read(self, schema=None) -> DataFrame | None:
        n = self._generation()
        if not n:
            return None
        return (self.spark.read if schema is None else self.spark.read.schema(schema)).parquet(f"{self.path}/g{n}")

    def add(self, chunks: DataFrame, key: str = "chunk_id", provider: str | None = None) -> int:
        """Append chunks whose ids are not there yet, and tell how many; of chunks that repeat an id the least text stays.

        Chunks without a column embedding get one from the provider of this name.
        """
        if "embedding" not in chunks.columns:
            chunks = embed(chunks, provider)
        held = self.read()
        new = chunks if held is None else incremental(chunks, held, key)
        w = Window.partitionBy(key).orderBy(*("text" for _ in range("text" in new.columns)), *(c for c in sorted(new.columns) if c not in (key, "text", "embedding")))
        once = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
        seen = Observation()
        once.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("department").parquet(f"{self.path}/g{max(1, self._generation())}")
        return seen.get["n"]

    def delete(self, ids: list[str], key: str = "chunk_id") -> int:
        """Returns the number of ids asked for, there or not."""
        held, n = self.read(), self._generation()
        if held is not None:
            gone = self.spark.createDataFrame([(i,) for i in ids], f"{key} string")
            without(held, gone, key).write.mode("overwrite").partitionBy("department").parquet(f"{self.path}/g{n + 1}")
            for old in subfolders(self.spark, self.path):
                if old != f"g{n + 1}":
                    delete_path(self.spark, f"{self.path}/{old}")
        return len(ids)

    def clear(self) -> None:
        delete_path(self.spark, self.path)

    def lookup(self, ids: list[str], key: str = "chunk_id") -> DataFrame:
        return point_lookup(self.read(), ids, key)

    def metadata(self, most: int = 10_000) -> DataFrame:
        return self.read().drop("text", "embedding").limit(most)


def point_lookup(df: DataFrame, ids: list, key: str) -> DataFrame:
    """The rows with these ids; each scores 1."""
    return df.filter(F.col(key).isin(ids)).withColumn("score", F.lit(1.0))


def incremental(new: DataFrame, held: DataFrame, key: str) -> DataFrame:
    return new.join(held.select(key), key, "left_anti")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def dataset_version(chunks: DataFrame, key: str = "chunk_id", columns: list[str] | None = None) -> DataFrame:
    """One row, version: 16 hex digits that change with any row, and "empty" without rows.

    Row digests are added up modulo 2**128 in two halves, so rows need neither sorting nor gathering in one task.
    """
    digest = F.sha2(F.to_json(F.struct(*(columns or sorted(chunks.columns)))), 256)
    part = lambda k: F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)"))
    sums = chunks.agg(F.count("*").alias("n"), part(0).alias("a"), part(1).alias("b"))
    return sums.select(F.when(F.col("n") == 0, "empty").otherwise(F.substring(F.sha2(F.concat_ws(":", "n", "a", "b"), 256), 1, 16)).alias("version"))


def manifest_of(chunks: DataFrame, provider: str, model: str, dimensions: int, index_path: str, chunks_file: str) -> dict:
    r = chunks.agg(F.count("*").alias("n"), F.count_distinct("course_id").alias("courses"), F.array_sort(F.collect_set("department")).alias("departments")).first()
    return {
        "dataset_version": dataset_version(chunks).first()["version"],
        "created_at": datetime.now(timezone.utc).isoformat(),
        "embedding_provider": provider,
        "embedding_model": model,
        "embedding_dimensions": dimensions,
        "total_chunks": r["n"],
        "total_courses": r["courses"],
        "departments": list(r["departments"]),
        "index_path": index_path,
        "chunks_file": chunks_file,
    }


def save_manifest(spark: SparkSession, root: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{manifest['dataset_version']}")


def delete_manifest(spark: SparkSession, root: str, version: str) -> bool:
    """Whether there was one."""
    return delete_path(spark, f"{root}/{version}")


def file_hashes(spark: SparkSession, path: str, digits: int = 64) -> DataFrame:
    """path, hash: the SHA-256 of each file under a folder, or of one file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.substring(F.sha2("content", 256), 1, digits).alias("hash"))


def load_manifests(spark: SparkSession, root: str) -> DataFrame:
    """All readable manifests; malformed ones are skipped."""
    schema = "dataset_version string, created_at string, embedding_provider string, embedding_model string, embedding_dimensions int, total_chunks long, total_courses long, departments array<string>, index_path string, chunks_file string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{root}/*").filter("dataset_version IS NOT NULL")


def latest_manifest(manifests: DataFrame) -> DataFrame:
    return manifests.agg(F.max_by(F.struct("*"), "created_at").alias("m")).filter("m IS NOT NULL").select("m.*")


def rebuild_reason(manifest: dict | None, chunks_exist: bool, version: str, provider: str, model: str) -> str | None:
    """Why the index must be built again, or None: the first that holds."""
    if not chunks_exist:
        return "no chunks"
    if manifest is None:
        return "no manifest"
    for field, value in (("dataset_version", version), ("embedding_provider", provider), ("embedding_model", model)):
        if manifest[field] != value:
            return f"{field} changed"
    return None
