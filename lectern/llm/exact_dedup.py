"""Exact deduplication through an extendible-hash index on shared files.

1. One pass writes an entry (doc_id, key, digest) for every row. The key is a 64-bit hash of the
   normalised text, the digest its SHA-256.
2. The directory: keys are counted by their leading bits. It starts with one slot; an overfull
   bucket splits on its next bit, and the directory doubles when that bucket uses all its bits.
   A bucket that is still overfull at the greatest depth stays one bucket and is only longer.
3. Owner tasks each take a contiguous range of buckets. Map tasks first fold equal texts of their
   own rows into one record, so a text with any number of copies reaches its owner as at most one
   record per map task. An owner reads its records in key order and keeps, for the key at hand
   only, the chain of distinct texts; records are equal only if their bytes are.
4. The index files hold one row per distinct text; entries join them by key and digest, and the row of the doc_id that
   the index names stays.

Rows with null text count as empty text. A null doc_id is the smallest. Of rows that repeat the
same doc_id and text (ties), exactly one is kept. Texts of any length are compared whole. Other columns pass
through drop_copies() unread, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm.common import packed, shuffle_partitions, stored, table, unpacked
from lectern.llm.words import release

MAX_DEPTH = 16
FOLD_BYTES = 32 << 20
NO_ID = -(1 << 63)


def normalised(column: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case; null is empty."""
    return pc.ascii_lower(pc.fill_null(column, ""))


def key_of(text: bytes, bits: int = 64) -> int:
    """The first `bits` bits of a 64-bit hash; fewer than 64 are for tests of collisions."""
    return (xxhash.xxh3_64_intdigest(text) >> (64 - bits) << (64 - bits)) - (1 << 63)


def with_digest(docs: DataFrame, name: str = "digest") -> DataFrame:
    """docs with the SHA-256 of the normalised text appended."""
    schema = docs.select("*", F.lit(b"").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.sha256(x.as_buffer()).digest() for x in normalised(batch.column(batch.schema.get_field_index("text")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def entries(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """doc_id, key, digest of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer() for x in normalised(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([key_of(x, key_bits) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())],
                ["doc_id", "key", "digest"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key long, digest binary")


class Directory:
    """An extendible-hash directory over the leading bits of 64-bit keys.

    slots[i] is the bucket of the keys whose first `depth` bits are i. Buckets are numbered in key
    order. cells: keys counted by their first `bits` bits.
    """

    def __init__(self, cells: dict[int, int], bits: int, capacity: int):
        counts = np.zeros(1 << bits, np.int64)
        for cell, n in cells.items():
            counts[cell] = n
        below = np.concatenate([[0], np.cumsum(counts)])
        size = lambda prefix, depth: int(below[(prefix + 1) << (bits - depth)] - below[prefix << (bits - depth)])
        self.depth, slots = 0, [(0, 0)]  # each slot names its bucket: prefix and local depth
        while True:
            full = {b for b in slots if size(*b) > capacity and b[1] < bits}
            if not full:
                break
            if any(local == self.depth for _, local in full):
                slots, self.depth = [b for b in slots for _ in range(2)], self.depth + 1
            slots = [((i >> (self.depth - b[1] - 1)), b[1] + 1) if b in full and b[1] < self.depth else b for i, b in enumerate(slots)]
        self.buckets = list(dict.fromkeys(slots))
        number = {b: i for i, b in enumerate(self.buckets)}
        self.slots = np.array([number[b] for b in slots], np.int64)
        self.sizes = np.array([size(*b) for b in self.buckets], np.int64)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        if not self.depth:
            return np.zeros(len(keys), np.int64)
        unsigned = keys.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        return self.slots[(unsigned >> np.uint64(64 - self.depth)).astype(np.int64)]

    def owners(self, n: int) -> np.ndarray:
        """Bucket -> owner: n contiguous ranges of about equally many keys."""
        middle = np.cumsum(self.sizes) - self.sizes / 2
        return np.minimum(n - 1, (middle * n / max(1, self.sizes.sum())).astype(np.int64)).astype(np.int32)


def build_directory(rows: DataFrame, capacity: int | None = None, bits: int = MAX_DEPTH) -> Directory:
    """Counts distinct keys by their first bits (at most 2**bits counts reach the driver)."""
    n = shuffle_partitions(rows.sparkSession)
    cell = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(NO_ID)), 64 - bits)
    cells = {int(r["cell"]): r["n"] for r in rows.select("key").distinct().groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).toLocalIterator()}
    return Directory(cells, bits, capacity or max(1, sum(cells.values()) // (8 * n)))


def records(docs: DataFrame, directory: Directory, n: int, key_bits: int = 64) -> DataFrame:
    """owner, bucket, key, body, keep_id, n: equal texts of a map task folded together, at most FOLD_BYTES of texts at a time."""
    owners = directory.owners(n)

    def flush(held: dict[bytes, list[int]]) -> pa.RecordBatch:
        keys = np.array([key_of(x, key_bits) for x in held], np.int64)
        bucket = directory.bucket(keys)
        return pa.RecordBatch.from_arrays(
            [pa.array(owners[bucket]), pa.array(bucket), pa.array(keys), pa.array(list(held), pa.binary()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1] for x in held.values()], pa.int64())],
            ["owner", "bucket", "key", "body", "keep_id", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        size = 0
        for batch in batches:
            ids = pc.fill_null(batch.column("doc_id").cast(pa.int64()), NO_ID).to_pylist()
            for doc_id, text in zip(ids, normalised(batch.column("text")), strict=True):
                body = text.as_buffer().to_pybytes()
                if (known := held.get(body)) is None:
                    held[body] = [doc_id, 1]
                    size += len(body)
                else:
                    known[0], known[1] = max(known[0], doc_id), known[1] + 1
                if size > FOLD_BYTES:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)
        release()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "owner int, bucket long, key long, body binary, keep_id long, n long")


def index(docs: DataFrame, directory: Directory, key_bits: int = 64) -> DataFrame:
    """bucket, key, digest, chain, keep_id, group_size: one row per distinct text, made by the owner tasks."""
    n = shuffle_partitions(docs.sparkSession)

    def links(chain: list[list]) -> list[tuple]:
        return [(bucket, key, hashlib.sha256(body).digest(), i, keep, count) for i, (bucket, key, body, keep, count) in enumerate(chain)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("digest", pa.binary()), ("chain", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
        chain: list[list] = []
        done: list[tuple] = []
        for batch in batches:
            bodies = batch.column("body")
            rest = [batch.column(c).to_pylist() for c in ("bucket", "key", "keep_id", "n")]
            for i, (bucket, key, keep, count) in enumerate(zip(*rest, strict=True)):
                if chain and chain[0][1] != key:
                    done += links(chain)
                    chain = []
                body = bodies[i].as_buffer()
                for link in chain:
                    if len(link[2]) == len(body) and body.equals(pa.py_buffer(link[2])):
                        link[3], link[4] = max(link[3], keep), link[4] + count
                        break
                else:
                    chain.append([bucket, key, body.to_pybytes(), keep, count])
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        done += links(chain)
        release()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    dealt = records(docs, directory, n, key_bits).repartitionById(n, "owner").drop("owner").sortWithinPartitions("bucket", "key")
    return dealt.mapInArrow(run, "bucket long, key long, digest binary, chain int, keep_id long, group_size long")


def exact_groups(docs: DataFrame, capacity: int | None = None, key_bits: int = 64) -> DataFrame:
    """doc_id, key, keep_id, group_size, kept, text_sha256, bucket, chain: one row per row of docs.

    Of equal normalised texts the row with the largest doc_id is kept. An empty table gives no rows.
    """
    rows = stored(entries(docs, key_bits).withColumn("row", F.monotonically_increasing_id()), "entries")
    files = index(docs, build_directory(rows, capacity), key_bits)
    files = stored(files, "index")
    same_id = F.coalesce("doc_id", F.lit(NO_ID)) == F.col("keep_id")
    # the index names the doc_id that stays; of rows that repeat it the last written one
    winner = rows.join(files.select("key", "digest", "keep_id"), ["key", "digest"]).filter(same_id).groupBy("key", "digest").agg(F.max("row").alias("keep_row"))
    index_rows = files.join(winner, ["key", "digest"])
    return rows.join(index_rows, ["key", "digest"]).select(
        "doc_id",
        "key",
        F.when(F.col("keep_id") != NO_ID, F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "bucket",
        "chain",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all columns of docs."""
    keep = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("_keep_id"), F.unhex("text_sha256").alias("_keep_digest"))
    rows = with_digest(packed(docs, "doc_id", "text"), "_digest")
    same = rows["doc_id"].cast("long").eqNullSafe(keep["_keep_id"]) & (rows["_digest"] == keep["_keep_digest"])
    return unpacked(rows.join(keep, same, "left_semi").dropDuplicates(["doc_id", "_digest"]), docs.columns, "doc_id", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("key", "bucket", "chain")


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
