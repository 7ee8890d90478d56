"""Centroid clustering of embeddings by Ptolemaic pivots.

Components become integers floor(1024 x), so all sums and distances are exact. Lloyd's rounds move the centroids to the floors of their
vectors' means. Which centroid is nearest is found by Ptolemy's inequality: for pivots p and q,

    d(x, c) * d(p, q) >= | d(x, p) * d(q, c) - d(x, q) * d(p, c) |.

1. Pivots and their pairs are fixed before the first round: all pairs of the first PIVOTS starting centroids. Every vector's distances to them are
   computed once and stored with its integers under the shared folder, as Parquet.
2. A round computes the centroids' distances to the pivots only. For each vector, the pairs give a lower bound for each centroid; the
   centroid of the least bound is measured first, then each whose bound does not exceed that distance. Bounds are rounded down by more
   than the error of all their floating-point steps, so no centroid that is nearest or ties is left out; survivors are measured in integers.
3. Each task adds up its vectors by cluster; Spark sums the rows of all tasks as decimals. The driver sees the k centroids only.

Vectors that are null, of another length, or with a null or non-finite component are left out. A null vec_id is kept and clustered, but
never starts a centroid. Repeated rows are vectors of their own; starts of equal vec_id go by their components. With fewer vectors with an
id than centroids, there are as many centroids as such vectors; with none, and for an empty table, there are no rows. Columns other than
vec_id and embedding are never read, whatever their names. Components up to 10^28 are exact, larger ones are an error; a distance or a sum of
distances that does not fit in 64 bits is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.llm.common import forget, stored, table
from lectern.llm.words import release

SCALE = 1024
#: Below this, products and sums of 64 components stay within 64 bits.
NARROW = 1 << 27
WIDEST = 10**28
#: Pivots at most: the starts of the first clusters.
PIVOTS = 8
#: Rows of a block.
ROWS = 4096
#: More than the relative error of a bound: six roundings of 2^-53, each at most doubled by those after it.
SLACK = 2.0**-46


def whole(column: Column, dims: int) -> Column:
    """Whether a vector has `dims` components, none null or non-finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(column) == dims) & F.forall(column, good), F.lit(False))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 x): 64-bit integers, or Python's where one needs more than NARROW."""
    if not x.size or np.abs(x).max() < NARROW / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    out = np.array([int(v) * SCALE if abs(v) >= 2.0**43 else int(np.floor(v * SCALE)) for v in x.ravel().tolist()], object).reshape(x.shape)
    if max(map(abs, out.ravel())) > WIDEST:
        raise ValueError(f"a component is beyond {WIDEST}")
    return out


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and matching rows (or one row)."""
    if x.dtype == object or c.dtype == object:
        x, c = x.astype(object), c.astype(object)
    d = x - c
    return (d * d).sum(-1)


def root(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64))


class Pivots:
    """Fixed pivots, their pairs, and the lower bounds that these give."""

    def __init__(self, points: np.ndarray):
        self.points = points
        pairs = [(i, j) for i in range(len(points)) for j in range(i)]
        self.pairs = [(i, j, math.sqrt(distances(points[i], points[j]))) for i, j in pairs]
        self.pairs = [p for p in self.pairs if p[2] > 0]

    def measure(self, x: np.ndarray) -> np.ndarray:
        """Each row's distances to the pivots."""
        return np.stack([root(distances(x, p)) for p in self.points], 1) if len(x) else np.zeros((0, len(self.points)))

    def bounds(self, held: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances, rounded down, from the rows' and the centroids' distances to the pivots."""
        best = np.zeros((len(held), len(centroids)))
        for i, j, across in self.pairs:
            one, other = np.outer(held[:, i], centroids[:, j]), np.outer(held[:, j], centroids[:, i])
            np.maximum(best, (np.abs(one - other) - SLACK * (one + other)) / across, out=best)
        return best * best * (1 - SLACK)


def nearest(x: np.ndarray, held: np.ndarray, centroids: np.ndarray, far: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, exact squared distance, distances measured); of equal ones the smaller number."""
    bound = pivots.bounds(held, far)
    first = bound.argmin(1)
    best, at = distances(x, centroids[first]), first.copy()
    left = bound <= (best.astype(np.float64) * (1 + SLACK))[:, None]
    left[np.arange(len(x)), first] = False
    measured = len(x)
    for c in range(len(centroids)):
        row = np.flatnonzero(left[:, c])
        if len(row):
            measured += len(row)
            d = distances(x[row], centroids[c])
            better = np.asarray((d < best[row]) | ((d == best[row]) & (c < at[row])), bool)
            best[row[better]], at[row[better]] = d[better], c
    return at, best, measured


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def _read(batch: pa.RecordBatch, pivots: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the batch, their integers, their distances to the pivots), narrow rows first."""
    narrow, wide = batch.column("narrow"), batch.column("wide")
    held = np.asarray(batch.column("held").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, pivots)
    is_wide = narrow.is_null().to_numpy(zero_copy_only=False)
    if (~is_wide).any():
        row = np.flatnonzero(~is_wide)
        yield row, np.frombuffer(b"".join(narrow.drop_null().to_pylist()), "<i4").astype(np.int64).reshape(len(row), -1), held[row]
    if is_wide.any():
        row = np.flatnonzero(is_wide)
        yield row, np.array([[int(v) for v in r] for r in wide.drop_null().to_pylist()], object), held[row]


def starts(vectors: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The k vectors of the smallest sha256 of `seed:vec_id`, in that order: k rows per task meet in the driver."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter(F.col("vec_id").isNotNull()).select(rank.alias("rank"), F.col("embedding").cast("array<double>").alias("v")).orderBy("rank", "v").limit(k).collect()
    return integers(np.array([r.v for r in rows], np.float64).reshape(len(rows), dims))


def prepared(vectors: DataFrame, pivots: Pivots, dims: int) -> DataFrame:
    """vec_id, narrow (integers as little-endian 32 bits) or wide (as texts), held (distances to the pivots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column("v"), dims)
                big = np.abs(x).max(1) >= NARROW / SCALE
                narrow, wide, held = [None] * len(x), [None] * len(x), np.zeros((len(x), len(pivots.points)))
                for rows in (np.flatnonzero(~big), np.flatnonzero(big)):
                    if len(rows):
                        whole_numbers = integers(x[rows])
                        held[rows] = pivots.measure(whole_numbers)
                        for r, row in zip(rows, whole_numbers, strict=True):
                            if whole_numbers.dtype == object:
                                wide[r] = [str(v) for v in row]
                            else:
                                narrow[r] = row.astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(narrow, pa.binary()), pa.array(wide, pa.list_(pa.string())), pa.array(list(held), pa.list_(pa.float64()))],
                    ["vec_id", "narrow", "wide", "held"],
                )
        release()

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).mapInArrow(run, f"vec_id {kind}, narrow binary, wide array<string>, held array<double>")


def summed(rows: DataFrame, centroids: np.ndarray, pivots: Pivots, dims: int) -> DataFrame:
    """cluster, dim, n, s: count and sum of a component of the vectors nearest to each centroid that has some."""
    k, far = len(centroids), pivots.measure(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for _, x, held in _read(batch.slice(at, ROWS), len(pivots.points)):
                    near = nearest(x, held, centroids, far, pivots)[0]
                    for c in np.unique(near):
                        mine = x[near == c]
                        count[c] += len(mine)
                        total[c] += mine.sum(0).astype(object)
        used = np.flatnonzero(count)
        text = [[str(v) for v in total[c]] for c in used]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(text, pa.list_(pa.string()))], ["cluster", "n", "s"])

    parts = rows.select("narrow", "wide", "held").mapInArrow(run, "cluster int, n long, s array<string>")
    parts = parts.select("cluster", "n", F.posexplode("s").alias("dim", "s"))
    return parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def moved(rows: DataFrame, centroids: np.ndarray, pivots: Pivots, dims: int) -> np.ndarray:
    """The centroids after a round: floors of the means, those without vectors as they were."""
    out = centroids.astype(object)
    for r in summed(rows, centroids, pivots, dims).collect():  # a row for each component of a centroid at most
        out[r.cluster, r.dim] = int(r.s) // r.n
    return out if max(map(abs, out.ravel())) >= NARROW else out.astype(np.int64)


def assigned(rows: DataFrame, centroids: np.ndarray, pivots: Pivots) -> DataFrame:
    """vec_id, cluster, distance as decimal, n_measured: how many distances had to be computed for the row's block, spread over its rows."""
    far = pivots.measure(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for row, x, held in _read(part, len(pivots.points)):
                    near, best, measured = nearest(x, held, centroids, far, pivots)
                    share = np.full(len(row), measured // len(row), np.int64)
                    share[: measured % len(row)] += 1
                    yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(row)), pa.array(near.astype(np.int32)), pa.array([str(d) for d in best]), pa.array(share)], ["vec_id", "cluster", "d", "n_measured"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"vec_id {kind}, cluster int, d string, n_measured long")
    return found.select("vec_id", "cluster", F.col("d").try_cast("decimal(38,0)").alias("distance"), "n_measured")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64) -> DataFrame:
    """vec_id, cluster, distance, n_measured, cluster_inertia, inertia, centroid (its components as texts), centroid_sha256."""
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "embedding").filter(whole(F.col("embedding"), dims))
    centroids = starts(vectors, k, seed, dims)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, n_measured long, cluster_inertia long, inertia long, centroid array<string>, centroid_sha256 string")
    pivots = Pivots(centroids[:PIVOTS])
    rows = stored(prepared(vectors, pivots, dims), "vectors")
    for _ in range(rounds):
        centroids = moved(rows, centroids, pivots, dims)
    found = stored(assigned(rows, centroids, pivots), "assigned")
    forget(rows)
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = None if None in sums.values() else sum(sums.values())
    long = lambda x: None if x is None or x >= 1 << 63 else int(x)
    about = [(c, long(sums.get(c, 0)), long(total), [str(v) for v in centroids[c]], digest(centroids[c])) for c in range(len(centroids))]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<string>, centroid_sha256 string")
    # k rows, the number of centroids asked for
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", F.col("distance").try_cast("long").alias("distance"), "n_measured", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
