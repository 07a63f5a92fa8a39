"""Event-time streams whose result does not depend on how rows fall into batches.

Rows wait in a buffer until the watermark has passed them: then no earlier row can
come any more, and they are released in (ts, value) order, by a timer at the earliest
row that waits.  Rows behind the watermark are late and dropped by Spark.  So the
causal filters of :mod:`.causal` see each signal in its own order, however late
within ``late``, and in whatever batches, its rows come.

A pause of more than ``gap`` ends a session: the filter starts anew with the next
row, and once the watermark has passed the pause the signal's state is dropped.

State is per signal: the rows of the last ``late`` and some numbers.  It needs the
RocksDB state store, which :func:`prepare` sets for the session.  Null times and null
values are dropped; rows that repeat are rows; an empty stream gives nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .causal import STEPS

OUTPUT = "signal_id string, session timestamp, ts timestamp, value double, denoised double"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


class Ordered(StatefulProcessor):
    """Buffers, releases and filters one signal's rows; times in microseconds."""

    def __init__(self, operator_id: str, params: dict, gap: int):
        self.operator_id, self.params, self.gap = operator_id, params, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, value double")
        self.held = handle.getValueState("held", "last bigint, session bigint, state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # While rows wait, the one timer is at the earliest of them, and need not be sought.
        first, begun = None, not self.waiting.exists()
        for frame in rows:
            new = list(zip(frame["us"].tolist(), frame["value"].tolist(), strict=True))
            if new:
                self.waiting.appendList(new)
                first = min(r[0] for r in new) if first is None else min(first, min(r[0] for r in new))
        if first is not None:
            self._wake(first, begun)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in waiting if r[0] <= passed]
        rest = waiting[len(ready) :]
        last, session, state = self.held.get() if self.held.exists() else (None, None, "{}")
        step, kept, out = STEPS[self.operator_id], json.loads(state), []
        for us, value in ready:
            if last is None or us - last > self.gap:
                session, kept = us, {}
            last = us
            out.append((key[0], session, us, value, step(kept, value, **self.params)))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if last is not None and last + self.gap < passed:
            self.held.clear()  # whatever comes next begins a session
        elif last is not None:
            self.held.update((last, session, json.dumps(kept)))
        if rest:
            self._wake(rest[0][0])
        elif last is not None and last + self.gap >= passed:
            self._wake(last + self.gap + 1000)  # the session's end
        else:
            self._sleep()
        if out:
            frame = pd.DataFrame(out, columns=["signal_id", "session", "ts", "value", "denoised"])
            for c in ("session", "ts"):
                frame[c] = pd.to_datetime(frame[c], unit="us", utc=True)
            yield frame

    def _wake(self, due: int, later: bool = True) -> None:
        """One timer: at the earliest row that waits, else at the session's end.  Where
        there is one already, a ``due`` not ``later`` only makes it earlier."""
        due, timers = -(-due // 1000), list(self.handle.listTimers())
        if not later and any(t <= due for t in timers):
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(due)

    def _sleep(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)


def denoise_ordered(samples: DataFrame, operator_id: str, params: dict | None = None, late: str = "10 minutes", gap: str = "1 hour") -> DataFrame:
    """A stream (signal_id, ts, value) with ``session`` (its first time) and
    ``denoised``; append mode."""
    prepare(samples.sparkSession)
    us = F.unix_micros("ts")
    given = samples.filter("ts IS NOT NULL AND value IS NOT NULL").withWatermark("ts", late).select("signal_id", "ts", us.alias("us"), "value")
    width = int(pd.Timedelta(gap) // pd.Timedelta(microseconds=1))
    return given.groupBy("signal_id").transformWithStateInPandas(Ordered(operator_id, params or {}, width), OUTPUT, "Append", "EventTime")


def session_levels(samples: DataFrame, late: str = "10 minutes", gap: str = "1 hour") -> DataFrame:
    """rms, peak, mean and count of each session, once it is over.  ``end`` is ``gap``
    after the last row; a pause of exactly ``gap`` ends a session."""
    held = samples.filter("ts IS NOT NULL AND value IS NOT NULL").withWatermark("ts", late).groupBy("signal_id", F.session_window("ts", gap).alias("w"))
    found = held.agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max(F.abs("value")).alias("peak"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return found.select("signal_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rms", "peak", "mean", "n")


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What a stream over stored files gives when all of them are read: written to
    ``path`` once each, whatever is repeated."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
