"""Request schedules by host as state of a stream: spacing, retries with growing waits, giving up, and forgetting quiet hosts.

Each host has a value (when its last request is due), a list (retries that wait) and event-time timers (when a retry is due, when the
host has been quiet for long). All of it lives in the checkpointed state store, so a restarted stream goes on with the same schedule, and
a first run can begin with the times at which hosts were last asked.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEDULE = "host string, url string, attempt int, due timestamp, gave_up boolean"


def _time(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


def _seconds(ts: datetime) -> float:
    return ts.timestamp()


class HostSchedule(StatefulProcessor):
    """Requests of a host in the order of their times: at least `gap` seconds apart, failures asked again up to `attempts` times in all after waits that double."""

    def __init__(self, gap: float, attempts: int, wait: float, longest_wait: float, keep: float):
        self.gap, self.attempts, self.wait, self.longest_wait, self.keep = gap, attempts, wait, longest_wait, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "due double")
        self.waiting = handle.getListState("waiting", "due double, url string, attempt int")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.last.update((_seconds(initialState.last_due),))

    def _timer(self, at: float, timers) -> None:
        """A timer in the future of the watermark, which may have passed the time itself."""
        self.handle.registerTimer(max(-int(-at * 1000 // 1), timers.getCurrentWatermarkInMs() + 1))

    def _next(self, host: str, url: str, attempt: int, at: float) -> Row:
        self.now_due = max(at, self.now_due + self.gap)
        return Row(host=host, url=url, attempt=attempt, due=_time(self.now_due), gave_up=False)

    def _released(self, host: str, until: float) -> Iterator[Row]:
        """Retries whose wait is over, in its order. Rows release those due before them, so it makes no difference whether a timer came first."""
        while self.retries and self.retries[0][0] <= until:
            due, url, attempt = self.retries.pop(0)
            yield self._next(host, url, attempt, due)

    def _loaded(self) -> None:
        self.now_due = self.last.get()[0] if self.last.exists() else float("-inf")
        self.retries = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []

    def _kept(self, timers) -> None:
        self.waiting.put(self.retries) if self.retries else self.waiting.clear()
        if self.now_due > float("-inf"):
            self.last.update((self.now_due,))
            self._timer(self.now_due + self.keep, timers)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        self._loaded()
        for r in sorted(rows, key=lambda r: (r.ts, r.url, r.failed_attempt or 0)):
            failed, ts = r.failed_attempt or 0, _seconds(r.ts)
            yield from self._released(key[0], ts)
            if not failed:
                yield self._next(key[0], r.url, 1, ts)
            elif failed >= self.attempts:
                yield Row(host=key[0], url=r.url, attempt=failed, due=None, gave_up=True)
            else:
                due = ts + min(self.longest_wait, self.wait * 2 ** (failed - 1))
                bisect.insort(self.retries, (due, r.url, failed + 1))
                self._timer(due, timerValues)
        self._kept(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        self._loaded()
        before = len(self.retries)
        yield from self._released(key[0], now)
        if len(self.retries) < before:
            self._kept(timerValues)
        elif not self.retries and self.now_due + self.keep <= now:  # nothing is due for long: the host needs no state
            self.last.clear()


def use_state_store(spark: SparkSession) -> None:
    """Keep the state of streams in RocksDB, which this state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def scheduled(requests: DataFrame, gap: float = 1.0, attempts: int = 3, wait: float = 1.0, longest_wait: float = 10.0, keep: float = 3600.0, late: str = "10 seconds", last_asked: DataFrame | None = None) -> DataFrame:
    """SCHEDULE of a stream of (host, url, ts, failed_attempt).

    A row without failed_attempt asks for a page, one with it reports that this attempt failed at ts: the page is asked for again once its wait is over
    in event time, or given up after `attempts` of them, with a row that has no due time. last_asked (host, last_due) is where a first run begins.
    """
    if requests.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError("call use_state_store(spark) first")
    grouped = requests.select("host", "url", "ts", "failed_attempt").withWatermark("ts", late).groupBy("host")
    start = None if last_asked is None else last_asked.select("host", "last_due").groupBy("host")
    return grouped.transformWithState(HostSchedule(gap, attempts, wait, longest_wait, keep), SCHEDULE, "append", "EventTime", start)
