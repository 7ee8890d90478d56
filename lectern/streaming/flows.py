"""Streams: pages to chunks with deduplication, windowed counts of events, and request spacing by host."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.functions.chunking import chunk_rows
from lectern.functions.cleaning import clean_text


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events with a watermark; ts comes without a time zone, which watermarks don't take."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return _counts(events, F.window("ts", width))


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    return _counts(events, F.window("ts", width, step))


def _counts(events: DataFrame, window) -> DataFrame:
    grouped = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def chunk_stream(pages: DataFrame, late: str = "1 day") -> DataFrame:
    """Chunks of pages (url, html, scraped_at) cleaned as in a batch, each text once within the watermark."""
    cleaned = pages.withColumn("text", clean_text(F.col("html"))).withWatermark("scraped_at", late)
    once = cleaned.withColumn("text_hash", F.sha2("text", 256)).dropDuplicatesWithinWatermark(["text_hash"])
    return chunk_rows(once, "url")


def host_spacing(requests: DataFrame, gap: float = 1.0, keep: float = 3600.0, late: str = "1 hour") -> DataFrame:
    """(host, url, due) of a stream of (host, url, ts): each host's requests at least `gap` seconds apart, by state per host, which goes `keep` seconds after its last one."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def space(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0.0
        for part in parts:
            due = []
            for ts in part.sort_values(["ts", "url"])["ts"]:
                last = max(ts.timestamp(), last + gap)
                due.append(pd.Timestamp(last, unit="s"))
            yield pd.DataFrame({"host": key[0], "url": part.sort_values(["ts", "url"])["url"].to_numpy(), "due": due})
        if state.hasTimedOut:  # quiet for long: nothing is due, so the host needs no state
            state.remove()
            return
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(1000 * (last + keep))))

    return requests.withWatermark("ts", late).groupBy("host").applyInPandasWithState(space, "host string, url string, due timestamp", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def index_batches(chunks: DataFrame, store, checkpoint: str, model=None, factory=None, cache=None):
    """Start a stream that puts chunks (chunk_id, text, department, ...) into a ChunkStore, embedded; returns the query.

    Each micro-batch is embedded (from the cache of vectors where there is one), held against the ids in the store and appended in one commit of its own. A batch
    that runs again after a crash finds its chunks there, if they had been committed, or else nothing of it: either way the store ends up the same.
    """
    from lectern.operators.embedding import HashModel, embedded

    used = model or HashModel()

    def vectored(batch: DataFrame) -> DataFrame:
        if cache is not None:
            return cache.embed(batch, used, factory)
        texts = batch.select(F.coalesce("text", F.lit("")).alias("text")).select(F.sha2("text", 256).alias("text_hash"), "text").dropDuplicates(["text_hash"])
        vectors = embedded(texts, factory or (lambda: used)).select(F.col("text_hash").alias("_hash"), "embedding")
        return batch.withColumn("_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).join(vectors, "_hash", "left").drop("_hash")

    def put(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            store.add(vectored(batch))

    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_chunks(pages: DataFrame, department: str = "all", late: str = "1 day") -> DataFrame:
    """What index_batches() takes, from a stream of pages."""
    chunks = chunk_stream(pages, late)
    return chunks.withColumnRenamed("chunk", "text").withColumns({"department": F.lit(department), "course_code": F.lit(""), "course_title": F.lit("")})


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Write what the stream has now and stop."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A file stream over a folder of event files."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
