"""Progress of flows while they run: counts per source, failures and rates, from what Spark measures on the way.

A batch flow is observed where its rows pass; a stream tells of each micro-batch to a listener. Nothing is counted in a second pass.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Name of the metrics that watched() adds to a stream.
METRICS = "lectern_progress"


def _counts(failed: Column | None) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)).alias("failed")]


def observed(df: DataFrame, failed: Column | None = None) -> tuple[DataFrame, Observation]:
    """df, and an observation whose .get has rows and failed once an action has run over it."""
    seen = Observation()
    return df.observe(seen, *_counts(failed)), seen


def watched(stream: DataFrame, failed: Column | None = None) -> DataFrame:
    """The stream with counts of its rows and failures in the progress of every micro-batch."""
    return stream.observe(METRICS, *_counts(failed))


class Progress(StreamingQueryListener):
    """What streams have done so far, by query name (or id): batches, rows, failed, rows by source, rows per second of the last batch, whether it ended and how.

    told(name, state) is called after every micro-batch, as a progress callback. Register with spark.streams.addListener(progress).
    """

    def __init__(self, told: Callable[[str, dict], None] | None = None):
        self.told, self.lock = told, threading.Lock()
        self.states: dict[str, dict] = {}
        self.names: dict[str, str] = {}

    def _state(self, id, name: str | None = None) -> tuple[str, dict]:  # noqa: A002
        known = self.names.setdefault(str(id), name or str(id))
        return known, self.states.setdefault(known, {"batches": 0, "rows": 0, "failed": 0, "by_source": {}, "rate": 0.0, "ended": False, "error": None})

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self.lock:
            self._state(event.id, event.name)[1]["ended"] = False

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self.lock:
            name, state = self._state(p.id, p.name)
            state["batches"] += 1
            state["rate"] = p.processedRowsPerSecond or 0.0
            for s in p.sources:
                state["by_source"][s.description] = state["by_source"].get(s.description, 0) + s.numInputRows
            seen = p.observedMetrics.get(METRICS)
            if seen is not None:
                state["rows"] += seen["rows"]
                state["failed"] += seen["failed"]
            now = dict(state)
        if self.told:
            self.told(name, now)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.lock:
            state = self._state(event.id)[1]
            state["ended"], state["error"] = True, event.exception
