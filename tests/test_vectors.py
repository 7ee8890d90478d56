import numpy as np
from pyspark.sql import functions as F

from lectern.operators import predicates, vectors


def test_zero_vectors_and_ties(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<float>")
    got = vectors.top_k(v, [1.0, 0.0], 3).collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 1.0), (3, 1.0), (1, 0.0)]
    batch = vectors.batch_top_k(v, v.withColumnRenamed("vec_id", "query_id"), 2).filter("query_id = 2").orderBy("rank").collect()
    assert [r.vec_id for r in batch] == [2, 3]


def test_empty_queries(spark):
    v = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert vectors.batch_top_k(v, v.limit(0).withColumnRenamed("vec_id", "query_id"), 2).count() == 0


def test_round_robin(spark):
    rows = spark.createDataFrame([("q", "se", 1, 0.9, 1), ("q", "se", 2, 0.8, 2), ("q", "se", 3, 0.7, 3), ("q", "ce", 4, 0.6, 1)], "query_id string, department string, vec_id long, score double, rank int")
    got = vectors.round_robin(rows, ["se", "ce"], 3).orderBy("place").collect()
    assert [r.score for r in got] == [0.9, 0.8, 0.6]


def test_filters(spark):
    assert predicates.matches(a=None, b=[]) is None
    rows = spark.createDataFrame([("se", 1), ("ce", 2), ("se", 2)], "department string, semester int")
    assert predicates.keep(rows, department=["se"], semester=2).count() == 1
    assert rows.filter(predicates.hit_filter(departments=["SE", "CE"], semester=2)).count() == 2


def test_filter_reaches_the_scan(spark, sf_dir):
    v = predicates.keep(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=[1, 2]).select("vec_id")
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "In(label, [1,2])" in plan and "embedding" not in plan.split("ReadSchema")[1]


def test_stats_of_nothing(spark):
    hits = spark.createDataFrame([], "department string, course_code string, score double")
    r = vectors.retrieval_stats(hits).first()
    assert (r["count"], r.max_score, r.departments) == (0, 0.0, [])
    assert F is not None


def test_blocks_of_several_tiles(spark):
    """More queries than are scored at a time: the same ranks as all at once, no query finds itself."""
    rng = np.random.default_rng(8)
    x = rng.integers(-9, 9, (2 * vectors.QUERY_TILE + 9, 5)).astype(float)
    v = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = vectors.batch_top_k(v, v.withColumnRenamed("vec_id", "query_id"), 1, skip_self=True).select("query_id", "vec_id", "score").collect()
    length = np.linalg.norm(x, axis=1)
    size = np.outer(length, length)
    score = np.divide(x @ x.T, size, out=np.zeros_like(size), where=size > 0)
    np.fill_diagonal(score, -9)
    assert len(got) == len(x) and all(r.query_id != r.vec_id and abs(r.score - score[r.query_id].max()) < 1e-9 for r in got)
