"""Per-key state carried through a stream: running averages and running labels that equal their batch forms however the rows arrive.

Rows wait in the key's state until the watermark has passed them, are then taken in the order of their time and id, and go through a step whose
state is a few numbers. Timers wake keys that get no more rows; state that nobody touches goes after `ttl`. Restarting from the checkpoint goes
on where it stopped. Rows later than the watermark are dropped by Spark before they reach the operator, as its `late` says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Step = Callable[[tuple | None, float], tuple]


class _Ordered(StatefulProcessor):
    """Rows (at, id, value) of a key in order through `step`; out come (key, id, value, result)."""

    def __init__(self, step: Step, state: str, ttl_ms: int):
        self.step, self.schema, self.ttl = step, state, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema, self.ttl or None)
        self.waiting = handle.getListState("waiting", "at long, id long, value double", self.ttl or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            fresh = list(zip(frame["at"].tolist(), frame["id"].tolist(), frame["value"].tolist(), strict=True))
            if fresh:
                self.waiting.appendList(fresh)
        yield from self._done(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._done(key, timerValues.getCurrentWatermarkInMs())

    def _done(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        waiting = sorted(tuple(w) for w in self.waiting.get())
        # times are in microseconds; rows of the watermark's own millisecond may still come
        ready = [w for w in waiting if w[0] < watermark * 1000]
        if ready:
            last, out = (tuple(self.last.get()) if self.last.exists() else None), []
            for _, name, value in ready:
                last = self.step(last, value)
                out.append((key[0], name, value, float(last[0])))
            self.last.update(last)
            rest = waiting[len(ready) :]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            yield pd.DataFrame(out, columns=["key", "id", "value", "result"])
        rest = waiting[len(ready) :]
        if rest:
            # the timer fires once the watermark has passed the first row that waits
            self.handle.registerTimer(rest[0][0] // 1000 + 1)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, ts: str, name: str, value: str, step: Step, state: str, late: str = "1 hour", ttl_ms: int = 0) -> DataFrame:
    """`events` is a stream: key, id, value, result of `step`, whose state is a row of `state` with the result first."""
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(name).cast("long").alias("id"), F.col(value).cast("double").alias("value"))
    rows = rows.where("key is not null and ts is not null").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(_Ordered(step, state, ttl_ms), "key long, id long, value double, result double", "Append", "EventTime")


def streamed_ema(events: DataFrame, alpha: float, key: str = "user_id", late: str = "1 hour", ttl_ms: int = 0) -> DataFrame:
    """operators.series.ema of a stream; a null value leaves the average as it is."""

    def step(last: tuple | None, x: float) -> tuple:
        if x is None or x != x:
            return last or (float("nan"),)
        return (x,) if last is None or last[0] != last[0] else (alpha * x + (1 - alpha) * last[0],)

    return in_order(events, key, "ts", "event_id", "value", step, "ema double", late, ttl_ms).withColumnRenamed("result", "ema")


def streamed_runs(events: DataFrame, width: float, key: str = "user_id", late: str = "1 hour", ttl_ms: int = 0) -> DataFrame:
    """The number, from 0, of the run of equal levels (value div width) that each row is in: operators.labels.runs of a stream."""

    def step(last: tuple | None, x: float) -> tuple:
        level = x // width if x is not None and x == x else float("-inf")
        return (0.0, level) if last is None else (last[0] + (last[1] != level), level)

    return in_order(events, key, "ts", "event_id", "value", step, "run double, level double", late, ttl_ms).withColumnRenamed("result", "run")
