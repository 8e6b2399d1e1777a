"""Rate limits, pacing and metric windows (ST2-ST4)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

VERDICT = "key string, seq long, allowed boolean, retry_after int"


def _judge(begun: float | None, count: int, now: float, limit: int, window: float) -> tuple[float, int, bool, int]:
    """One event of a key: the window's start and count after it, and the verdict."""
    if begun is None or now - begun >= window:
        begun, count = now, 0
    if count >= limit:
        return begun, count, False, max(1, math.ceil(window - (now - begun)))
    return begun, count + 1, True, 0


def fixed_window(events: DataFrame, limit: int, window: float) -> DataFrame:
    """ST2: events(key, seq, ts): a window opens at a key's first event; ``limit`` are admitted in it.

    Streams over each partition in order of key and time, so no key is held in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, begun, count = None, None, 0
        for batch in batches:
            out = []
            for k, seq, now in zip(batch["key"], batch["seq"], batch["t"], strict=True):
                if k != key:
                    key, begun, count = k, None, 0
                begun, count, allowed, wait = _judge(begun, count, now, limit, window)
                out.append((k, seq, allowed, wait))
            yield pd.DataFrame(out, columns=["key", "seq", "allowed", "retry_after"])

    timed = events.select(F.col("key").cast("string").alias("key"), "seq", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return timed.repartition("key").sortWithinPartitions("key", "t", "seq").mapInPandas(run, VERDICT)


class WindowLimiter(StatefulProcessor):
    """A key's open window and its events that the watermark has not passed yet.

    Events are judged in order of time and seq once the watermark has passed them, so the order of arrival does
    not count, as long as they are not later than the watermark allows. A window that the watermark has left
    behind is forgotten by a timer.
    """

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "begun double, count int")
        self.waiting = handle.getListState("waiting", "t double, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = math.inf
        for batch in rows:
            for t, seq in zip(batch["t"], batch["seq"], strict=True):
                self.waiting.appendValue((float(t), int(seq)))
                first = min(first, t)
        self.handle.registerTimer(math.ceil(first * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        begun, count = self.open.get() if self.open.exists() else (None, 0)
        out = []
        for t, seq in [e for e in events if e[0] <= passed]:
            begun, count, allowed, wait = _judge(begun, count, t, self.limit, self.window)
            out.append((key[0], seq, allowed, wait))
        later = events[len(out) :]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(math.ceil(later[0][0] * 1000))
        else:
            self.waiting.clear()
        if begun is None or begun + self.window <= passed:
            self.open.clear()
        else:
            self.open.update((begun, count))
            self.handle.registerTimer(math.ceil((begun + self.window) * 1000))
        if out:
            yield pd.DataFrame(out, columns=["key", "seq", "allowed", "retry_after"])

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def fixed_window_stream(events: DataFrame, limit: int, window: float, late: str = "10 seconds") -> DataFrame:
    """ST2 over a stream of events(key, seq, ts): the verdicts of fixed_window, in event time.

    Events that come later than ``late`` behind the latest one are dropped. The session must keep its state in
    RocksDB (``spark.sql.streaming.stateStore.providerClass``), which timers ask for.
    """
    timed = events.select(F.col("key").cast("string").alias("key"), "seq", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    timed = timed.withColumn("t", F.unix_micros("ts") / 1e6)
    return timed.groupBy("key").transformWithStateInPandas(WindowLimiter(limit, window), VERDICT, "append", "EventTime")


def paced_slots(events: DataFrame, interval: float) -> DataFrame:
    """ST3: the delay of each request of a key if one is let through an interval, in closed form."""
    w = Window.partitionBy("key").orderBy("ts", "seq")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    i = F.row_number().over(w) - 1
    rows = events.withColumns({"__t": t, "__i": i})
    latest = F.max(F.col("__t") - F.col("__i") * interval).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("delay", F.col("__i") * interval + latest - F.col("__t")).drop("__t", "__i")


def metric_windows(records: DataFrame, alert_above: float, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """ST4: records(ts, name, value) in tumbling windows; works on tables and, with a watermark, on streams."""
    rows = records.withWatermark("ts", late) if records.isStreaming else records
    out = rows.groupBy(F.window("ts", length).alias("w"), "name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    return out.select(F.col("w.start").alias("window_start"), "name", "n", "mean", "most", (F.col("most") > alert_above).alias("alert"))
