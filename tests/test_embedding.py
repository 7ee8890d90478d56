import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import embedding


class Touchy(embedding.Model):
    """Fails on batches and texts with a bad word, and writes down what it is asked."""

    name, dimensions, batch_size = "touchy", 3, 4

    def __init__(self, log):
        self.log = log

    def embed(self, texts, form):
        with open(self.log, "a") as f:
            f.write("".join(f"{form}:{t}\n" for t in texts))
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return np.array([[len(t), t.count("a"), form == "query"] for t in texts], float)


@pytest.fixture
def touchy(tmp_path):
    log = str(tmp_path / "asked")
    return Touchy(log), (lambda: Touchy(log)), lambda: open(log).read().split("\n")[:-1] if (tmp_path / "asked").exists() else []


def test_second_run_embeds_nothing(spark, tmp_path, touchy):
    used, factory, asked = touchy
    cache = embedding.EmbeddingCache(spark, str(tmp_path / "cache"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "b", "aa", None, "", "  ", "a c"])], "id long, text string")
    got = {r.id: r.embedding for r in cache.embed(docs, used, factory).collect()}
    assert got == {0: [2, 2, 0], 1: [1, 0, 0], 2: [2, 2, 0], 3: [0, 0, 0], 4: [0, 0, 0], 5: [0, 0, 0], 6: [3, 1, 0]}
    assert sorted(asked()) == ["document:a c", "document:aa", "document:b"]
    assert {r.id: r.embedding for r in cache.embed(docs, used, factory).collect()} == got and len(asked()) == 3
    more = docs.unionByName(spark.createDataFrame([(9, "new a")], "id long, text string"))
    assert cache.fill(more, used, factory) == 1 and asked()[3:] == ["document:new a"]
    # queries are other vectors of the same texts
    assert cache.embed(docs.filter("id = 1"), used, factory, "query").first().embedding == [1, 0, 1]
    assert cache.held(used, "document").count() == 6 and cache.held(used, "query").count() == 1


def test_failed_texts_spare_their_batch(spark, tmp_path, touchy):
    used, factory, asked = touchy
    cache = embedding.EmbeddingCache(spark, str(tmp_path / "cache"))
    docs = spark.createDataFrame([(0, "a"), (1, "bad"), (2, "aaa")], "id long, text string").coalesce(1)
    got = {r.id: r.embedding for r in cache.embed(docs, used, factory).collect()}
    assert got == {0: [1, 1, 0], 1: None, 2: [3, 3, 0]}
    before = len(asked())
    cache.embed(docs, used, factory).collect()
    assert asked()[before:] == ["document:bad", "document:bad"]  # as a batch, then alone
    assert embedding.embedded(docs.select(F.col("id").cast("string").alias("text_hash"), "text"), factory).filter("error = 'bad text'").count() == 1


def test_models_by_name(spark, tmp_path):
    embedding.register_model("Mine", lambda: Touchy(str(tmp_path / "x")))
    assert embedding.model(" mine ") is embedding.model("MINE")
    assert embedding.model().info() == {"name": "hash-words", "dimensions": 64, "batch_size": 512, "available": True}
    with pytest.raises(ValueError):
        embedding.model("nope")
    with pytest.raises(ValueError):
        embedding.embedded(spark.createDataFrame([], "text_hash string, text string"), embedding.HashModel, "other")
    one, other = embedding.HashModel().embed(["trees and graphs", "graphs and trees"], "document")
    assert np.allclose(one, other) and abs(np.linalg.norm(one) - 1) < 1e-9

    class Off(embedding.HashModel):
        def available(self):
            return False

    with pytest.raises(RuntimeError):
        embedding.EmbeddingCache(spark, str(tmp_path)).fill(spark.createDataFrame([("x",)], "text string"), Off())
    with pytest.raises(NotImplementedError):
        embedding.Model().embed(["x"], "query")


def test_empty(spark, tmp_path):
    cache = embedding.EmbeddingCache(spark, str(tmp_path / "cache"))
    nothing = spark.createDataFrame([], "id long, text string")
    assert cache.embed(nothing, embedding.HashModel()).count() == 0
