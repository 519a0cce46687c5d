"""The anchored rate limiter over a stream, with its state kept per key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

OUTPUT = "key string, event_id long, seconds double, window_start double, count int, accepted boolean"


def limited(events: DataFrame, window: int = 600, most: int = 12) -> DataFrame:
    """A decision per event of the stream ``events(key string, event_id long, seconds double)``.

    A window begins with the first event after the last window's end; refused events
    count.  Within a micro-batch a key's events are taken in order of time and id;
    one that arrives in a later batch with an earlier time counts in the open window.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (float("-inf"), 0)
        rows = pd.concat(list(batches)).sort_values(["seconds", "event_id"])
        starts, counts = [], []
        for t in rows["seconds"]:
            start, n = (t, 1) if t - start >= window else (start, n + 1)
            starts.append(start)
            counts.append(n)
        state.update((float(start), int(n)))
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"].to_numpy(), "seconds": rows["seconds"].to_numpy(), "window_start": starts, "count": counts, "accepted": [c <= most for c in counts]})

    return events.groupBy("key").applyInPandasWithState(decide, OUTPUT, "start double, n int", "append", GroupStateTimeout.NoTimeout)


class _Limiter(StatefulProcessor):
    """Of a key: the open window, and events that wait until the watermark has passed them."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start double, n int")
        self.waiting = handle.getListState("waiting", "seconds double, event_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            self.waiting.appendList(list(zip(part["seconds"].astype(float), part["event_id"].astype(int), strict=True)))
            first = float(part["seconds"].min())
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake(earliest)
        return iter([])

    def _wake(self, seconds: float) -> None:
        self.handle.registerTimer(math.ceil(seconds * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [w for w in waiting if math.ceil(w[0] * 1000) <= now]
        start, n = self.open.get() if self.open.exists() else (float("-inf"), 0)
        out = []
        for seconds, event in due:
            start, n = (seconds, 1) if seconds - start >= self.window else (start, n + 1)
            out.append((key[0], event, seconds, start, n, n <= self.most))
        rest = waiting[len(due) :]
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        elif waiting:
            self.waiting.clear()
        over = (start + self.window) * 1000 <= now if n else True
        if over and not rest:
            # No event that may still come, or waits, falls into the window: the key leaves the state.
            self.open.clear()
        elif n:
            self.open.update((float(start), int(n)))
            if not over:
                self._wake(start + self.window)
        if out:
            yield pd.DataFrame(out, columns=["key", "event_id", "seconds", "window_start", "count", "accepted"])

    def close(self) -> None:
        pass


def limited_in_order(events: DataFrame, window: int = 600, most: int = 12, delay: str = "10 minutes") -> DataFrame:
    """A decision per event of the stream ``events(key string, event_id long, seconds double)``, those of the batch fold whatever the order of arrival.

    An event waits until the watermark (the largest time seen less ``delay``) has
    passed it, and is then decided on in order of time and id.  One that comes after
    the watermark has passed it is late: it has no decision and counts in no window
    (Spark's progress tells how many there were).  A key's state is its open window
    and the events of the last ``delay``; both leave with the watermark, so the
    state is as large as the keys and events of the last window and delay.  Needs
    the RocksDB state store; a restart from the checkpoint goes on where it was.
    """
    timed = events.withColumn("at", F.timestamp_micros((F.col("seconds") * 1_000_000).cast("long"))).withWatermark("at", delay)
    return timed.groupBy("key").transformWithStateInPandas(_Limiter(window, most), OUTPUT, "append", "EventTime")
