import time

import pytest
from pyspark.sql import functions as F

from lectern.streaming import progress

SCHEMA = "url string, status int"


def until(met, seconds=60):
    end = time.time() + seconds
    while not met() and time.time() < end:
        time.sleep(0.2)
    assert met()


def test_batch_is_observed_where_it_passes(spark, tmp_path):
    pages = spark.createDataFrame([("a", 200), ("b", 0), ("c", None)], SCHEMA)
    df, seen = progress.observed(pages, F.col("status") == 0)
    df.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"rows": 3, "failed": 1}
    df, seen = progress.observed(pages)
    df.count()
    assert seen.get == {"rows": 3, "failed": 0}


def test_running_and_finished_streams(spark, tmp_path):
    """Counts of a stream while it runs, batch by batch, and after its end, well or badly."""
    folder = str(tmp_path / "in")
    add = lambda *rows: spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    add(("a", 200), ("b", 0))
    told = []
    listener = progress.Progress(lambda name, state: told.append((name, state["rows"], state["failed"])))
    spark.streams.addListener(listener)
    try:
        stream = progress.watched(spark.readStream.schema(SCHEMA).parquet(folder), F.col("status") == 0)
        query = stream.writeStream.queryName("pages").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
        until(lambda: listener.states.get("pages", {}).get("rows") == 2)
        add(("c", 0), ("d", 0), ("e", 200))
        until(lambda: listener.states["pages"]["rows"] == 5)
        assert query.isActive and not listener.states["pages"]["ended"] and listener.states["pages"]["failed"] == 3
        assert sum(listener.states["pages"]["by_source"].values()) == 5
        query.stop()
        until(lambda: listener.states["pages"]["ended"])
        assert listener.states["pages"]["error"] is None and ("pages", 2, 1) in told and ("pages", 5, 3) in told

        def fail(batch, _):
            raise RuntimeError("no room")

        bad = stream.writeStream.queryName("bad").foreachBatch(fail).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="no room"):
            bad.awaitTermination()
        until(lambda: listener.states.get("bad", {}).get("ended", False))
        assert "no room" in listener.states["bad"]["error"]
    finally:
        spark.streams.removeListener(listener)
