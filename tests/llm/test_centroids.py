import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import centroids


def plain(vectors, k=8, rounds=10, seed=3, dims=64):
    """Lloyd's rounds by the definition, in Python's integers."""
    kept = [(i, [math.floor(1024 * float(x)) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"{seed}:{x[0]}".encode()).hexdigest(), x[1]))
    c = [v for _, v in order[:k]]
    if not c:
        return []
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [min((gap(v, c[j]), j) for j in range(len(c))) for _, v in kept]
    for _ in range(rounds):
        at = near()
        for j in range(len(c)):
            mine = [kept[i][1] for i, x in enumerate(at) if x[1] == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    at = near()
    long = lambda x: x if x < 1 << 63 else None
    sums = [sum(d for d, j in at if j == n) for n in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return [(kept[i][0], j, long(d), long(sums[j]), long(sum(sums)), digest[j]) for i, (d, j) in enumerate(at)]


def rows(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_query_equals_plain(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows(centroids.query(spark, sf_dir)) == sorted(plain(vectors), key=str)


@pytest.mark.parametrize("wide", [False, True])
def test_odd_vectors(spark, wide):
    rng = np.random.default_rng(5)
    good = [(i, [float(x) for x in rng.normal(size=4).astype(np.float32)]) for i in range(60)]
    tied = [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(20)] + [(100, [1.0, 0.0, 0.0, 0.0]), (100, [-1.0, 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5])]
    odd = [(200, None), (201, []), (202, [1.0, 2.0, 3.0]), (203, [1.0, None, 0.0, 0.0]), (204, [1.0, float("nan"), 0.0, 0.0]), (205, [float("inf"), 0.0, 0.0, 0.0]), (206, [0.0] * 5)]
    far = [(300, [3e6, -3e6, 0.1, 1e7]), (301, [3e6, -3e6, 0.1, 1e7 + 1]), (302, [1e20, 1e20, -1e20, 1.0])] if wide else []
    vectors = good + tied + odd + far
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "n": F.lit(1), "distance": F.lit(2), "held": F.lit(3)}).repartition(3)
    got = rows(centroids.cluster(df, k=5, rounds=4, dims=4))
    assert got == sorted(plain(vectors, 5, 4, 3, 4), key=str)
    assert any(r[2] is None for r in got) == any(r[2] is None for r in plain(vectors, 5, 4, 3, 4))


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert rows(centroids.cluster(df, dims=2)) == sorted(plain([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [0.0, 0.0])], dims=2), key=str)
    assert centroids.cluster(df.limit(0), dims=2).collect() == []
    assert centroids.cluster(df.filter("vec_id IS NULL"), dims=2).collect() == []


def test_bounds_hold_and_spare_work():
    """No bound is above the exact distance, and among real clusters most distances need no computing."""
    rng = np.random.default_rng(1)
    middles = rng.integers(-4000, 4000, (12, 64))
    x = (middles[rng.integers(0, 12, 3000)] + rng.integers(-60, 60, (3000, 64))).astype(np.int64)
    c = middles.astype(np.int64)
    pivots = centroids.Pivots(c[:8])
    held, far = pivots.measure(x), pivots.measure(c)
    exact = np.stack([centroids.distances(x, v) for v in c], 1)
    assert (pivots.bounds(held, far) <= exact).all()
    at, best, measured = centroids.nearest(x, held, c, far, pivots)
    assert (at == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert measured < 0.5 * x.shape[0] * len(c)
    # a centroid that is a vector itself, pivots that coincide, and ties
    same = np.stack([x[0], x[0], x[1]])
    pivots = centroids.Pivots(same)
    at, best, _ = centroids.nearest(x, pivots.measure(x), same, pivots.measure(same), pivots)
    assert at[0] == 0 and best[0] == 0 and not (at == 1).any()


def test_plan_keeps_rows_in_tasks(spark, sf_dir):
    """A round sends at most a row per task, centroid and component through the shuffle, and reads no other columns."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    c = centroids.starts(vectors, 3, 3, 64)
    pivots = centroids.Pivots(c)
    held = spark.createDataFrame(centroids.prepared(vectors, pivots, 64).collect(), "vec_id long, narrow binary, wide array<string>, held array<double>").repartition(4)
    sums = centroids.summed(held, c, pivots, 64)
    assert sums.count() == 3 * 64 and sums.filter("dim = 0").agg(F.sum("n")).first()[0] == vectors.count()
