"""Pages: a cache of fetched pages with a time to live, and fetching as an Arrow map with errors as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PAGE = "url string, html string, status_code int, scraped_at timestamp, error string"


def domain(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def cache_folder(url: Column) -> Column:
    return F.replace(domain(url), F.lit("."), F.lit("_"))


def fresh(cache: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """Cached pages younger than `days` days; 0 days: none."""
    now = F.current_timestamp() if now is None else now
    return cache.filter(F.lit(days > 0) & (F.col("scraped_at") + F.expr(f"INTERVAL {int(days)} DAYS") > now))


def to_fetch(urls: DataFrame, cache: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    return urls.select("url").distinct().join(fresh(cache, days, now).select("url"), "url", "left_anti")


def worth_caching(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("status_code").between(200, 299))


def write_cache(pages: DataFrame, path: str) -> None:
    worth_caching(pages).withColumn("domain", cache_folder(F.col("url"))).write.mode("append").partitionBy("domain").parquet(path)


def clear_cache(spark: SparkSession, path: str, url: str | None = None) -> int:
    """Delete the cached pages of one address, or all; returns how many pages went. The others are written anew beside it first."""
    from lectern.sources.readers import delete_path, path_exists

    if not path_exists(spark, path):
        return 0
    cache = spark.read.parquet(path)
    gone = cache if url is None else cache.filter(F.col("url") == url)
    n = gone.count()
    if url is None:
        delete_path(spark, path)
    elif n:
        rest = f"{path.rstrip('/')}-rest"
        cache.filter(~F.col("url").eqNullSafe(url)).write.mode("overwrite").partitionBy("domain").parquet(rest)
        spark.read.parquet(rest).write.mode("overwrite").partitionBy("domain").parquet(path)
        delete_path(spark, rest)
    return n


def fetch(urls: DataFrame, gap: float = 1.0, attempts: int = 3, timeout: float = 30.0, longest_wait: float = 10.0, get=None) -> DataFrame:
    """One row per url. A page that can't be had after all attempts has status 0, no html and its error.

    All addresses of a host are one task's, which waits `gap` seconds between its requests to the host and doubling times after failures, so
    the gap holds per host however many tasks run; meanwhile the task asks other hosts. The number of shuffle partitions bounds how many tasks
    fetch at once. get(url, timeout) -> (status, html) replaces the plain HTTP request.
    """

    def plain(url: str, timeout: float) -> tuple[int, str]:
        import urllib.request

        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import heapq
        import time

        request = get or plain
        ready: dict[str, float] = {}
        for part in parts:
            # (when, place, url, attempt): the request that may go first
            waiting = [(0.0, i, url, host, 1) for i, (url, host) in enumerate(zip(part["url"], part["host"], strict=True))]
            heapq.heapify(waiting)
            rows = []
            while waiting:
                when, i, url, host, attempt = heapq.heappop(waiting)
                free = max(when, ready.get(host, 0.0))
                if free > when and free > time.monotonic():  # its host is not free yet: others first
                    heapq.heappush(waiting, (free, i, url, host, attempt))
                    continue
                time.sleep(max(0.0, free - time.monotonic()))
                ready[host] = time.monotonic() + gap
                try:
                    status, html = request(url, timeout)
                    rows.append((url, html, status, pd.Timestamp.now("UTC").tz_localize(None), None))
                except Exception as e:  # an error is a row
                    if attempt < attempts:
                        heapq.heappush(waiting, (time.monotonic() + min(longest_wait, gap * 2 ** (attempt - 1)), i, url, host, attempt + 1))
                    else:
                        rows.append((url, "", 0, pd.Timestamp.now("UTC").tz_localize(None), str(e)[:500]))
            yield pd.DataFrame(rows, columns=["url", "html", "status_code", "scraped_at", "error"])

    return urls.select("url", F.coalesce(domain(F.col("url")), F.lit("")).alias("host")).repartition("host").mapInPandas(run, PAGE)


def read_through(urls: DataFrame, path: str, days: int, **how) -> DataFrame:
    """Pages of the urls: fresh ones from the cache, the others fetched and, where that went well, written to the cache first."""
    from uuid import uuid4

    from lectern.sources.readers import path_exists

    spark = urls.sparkSession
    cache = spark.read.schema(f"{PAGE}, domain string").parquet(path) if path_exists(spark, path) else spark.createDataFrame([], f"{PAGE}, domain string")
    held = fresh(cache, days).select("url", "html", "status_code", "scraped_at", "error")
    last = held.groupBy("url").agg(F.max_by(F.struct("*"), "scraped_at").alias("p")).select("p.*")
    known = last.join(urls.select("url").distinct(), "url", "left_semi")
    # what is fetched, failures too, is written before anything reads it: no page is asked for twice, also if an executor is lost
    run = f"{path.rstrip('/')}-run-{uuid4().hex}"
    fetch(to_fetch(urls, cache, days), **how).write.parquet(run)
    new = spark.read.schema(PAGE).parquet(run)
    write_cache(new, path)
    return known.unionByName(new)


def fetch_stats(pages: DataFrame) -> DataFrame:
    """One row: requests, failures, rates (0 without requests)."""
    ok = F.count_if(F.col("status_code").between(200, 299))
    return pages.agg(F.count("*").alias("pages"), ok.alias("succeeded"), F.count_if(F.col("status_code") == 0).alias("failed"), F.coalesce(F.try_divide(ok, F.count("*")), F.lit(0.0)).alias("success_rate"))
