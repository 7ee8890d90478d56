import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.operators import embedding, store
from lectern.streaming import flows

PAGES = "url string, html string, scraped_at timestamp"


def page(i, text):
    return (f"http://a/{i}", f"<p>{text} is long enough to be a chunk of its own</p>", dt.datetime(2024, 1, 1, 0, i))


def stream(spark, folder):
    return flows.page_chunks(spark.readStream.schema(PAGES).parquet(str(folder)), "se")


def content(s):
    return sorted((r.chunk_id, r.text, tuple(r.embedding)) for r in s.read().collect())


def test_pages_reach_the_index_once(spark, tmp_path):
    """Pages, embedded, in the store; a second run adds only what is new."""
    s = store.ChunkStore(spark, str(tmp_path / "index"))
    cache = embedding.EmbeddingCache(spark, str(tmp_path / "vectors"))
    spark.createDataFrame([page(1, "one"), page(2, "two"), page(3, "one")], PAGES).coalesce(1).write.parquet(str(tmp_path / "pages"))
    flows.index_batches(stream(spark, tmp_path / "pages"), s, str(tmp_path / "c"), cache=cache).awaitTermination()
    first = content(s)
    assert len(first) == 2 and all(abs(sum(x * x for x in e) - 1) < 1e-3 for _, _, e in first)
    spark.createDataFrame([page(4, "four")], PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    flows.index_batches(stream(spark, tmp_path / "pages"), s, str(tmp_path / "c"), cache=cache).awaitTermination()
    assert len(content(s)) == 3 and set(first) < set(content(s))
    assert cache.held(embedding.HashModel()).count() == 3


@pytest.mark.parametrize("crash", ["before", "after"])
def test_a_batch_replayed_after_a_crash(spark, tmp_path, crash):
    """A batch dies before or after its rows are in the store, and runs again from the checkpoint: the store is the same as without the crash."""

    class Dying(store.ChunkStore):
        def add(self, chunks, *args, **how):
            if crash == "after":
                super().add(chunks, *args, **how)
            raise RuntimeError("the driver dies here")

    spark.createDataFrame([page(i, f"page {i}") for i in range(5)], PAGES).coalesce(1).write.parquet(str(tmp_path / "pages"))
    where = str(tmp_path / "index")
    with pytest.raises(Exception, match="dies here"):
        flows.index_batches(stream(spark, tmp_path / "pages"), Dying(spark, where), str(tmp_path / "c")).awaitTermination()
    s = store.ChunkStore(spark, where)
    assert (s.read() is None) == (crash == "before")
    flows.index_batches(stream(spark, tmp_path / "pages"), s, str(tmp_path / "c")).awaitTermination()
    plain = store.ChunkStore(spark, str(tmp_path / "plain"))
    flows.index_batches(stream(spark, tmp_path / "pages"), plain, str(tmp_path / "c2")).awaitTermination()
    assert content(s) == content(plain) and len(content(s)) == 5


def test_delete_survives_a_crash(spark, tmp_path):
    """What a delete leaves half written is not read; the next delete clears it away."""
    s = store.ChunkStore(spark, str(tmp_path / "index"))
    rows = spark.createDataFrame([(str(i), f"text {i}", "se") for i in range(4)], "chunk_id string, text string, department string")
    s.add(rows)
    # a crash in the middle: the next generation has rows, but no mark that it is whole
    s.read().filter("chunk_id = '0'").write.partitionBy("department").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{s.path}/g2")
    assert s.read().count() == 4
    assert s.delete(["1"]) == 1 and s.read().count() == 3
    # a crash before the old generation is dropped
    s.read().write.partitionBy("department").parquet(f"{s.path}/g1")
    assert s.read().count() == 3 and s.add(rows) == 1
    s.delete(["3"])
    assert sorted(r.chunk_id for r in s.read().collect()) == ["0", "1", "2"] and s.read().agg(F.count("*")).first()[0] == 3
