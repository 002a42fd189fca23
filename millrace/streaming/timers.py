"""Keyed state with event-time timers: alerts that fire once for good, and dwell times that end or expire.

Both keep their state in the RocksDB store, which the caller's session names (`use_rocksdb`), and restart from
the stream's checkpoint where they stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers need; set before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Once(StatefulProcessor):
    """Lets the first alert of a key through, the earliest of those that come together, and none after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fired = handle.getValueState("fired", "at_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        if self.fired.exists():
            return
        first = min(int(x) for f in frames for x in f["at_us"])
        self.fired.update((first,))
        yield pd.DataFrame({"dedup_key": [str(key[0])], "at_us": [first]})

    def close(self) -> None:
        pass


def fire_once(stream: DataFrame, key: Column, at: str) -> DataFrame:
    """(dedup_key, at_us): each key's alert once, whatever the time between its causes.  A key costs one number, kept for good."""
    rows = stream.select(key.cast("string").alias("dedup_key"), F.unix_micros(F.col(at)).alias("at_us"))
    return rows.groupBy("dedup_key").transformWithStateInPandas(statefulProcessor=_Once(), outputStructType="dedup_key string, at_us long", outputMode="Append", timeMode="None")


class _Dwell(StatefulProcessor):
    """Events wait for the watermark, so that their order is that of their times across micro-batches."""

    def __init__(self, enter: str, leave: str, most_ms: int):
        self.enter, self.leave, self.most = enter, leave, most_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_ms long, kind string")
        self.since = handle.getValueState("since", "at_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at, kind in zip(frame["at_ms"], frame["kind"], strict=True):
                self.waiting.appendValue((int(at), kind))
                self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((e for e in held if e[0] <= now), key=lambda e: (e[0], e[1] != self.leave))
        rest = [e for e in held if e[0] > now]
        since = self.since.get()[0] if self.since.exists() else None
        out = []

        def expire(at: int) -> None:
            nonlocal since
            if since is not None and at >= since + self.most:
                out.append((str(key[0]), since, since + self.most, "expired"))
                since = None

        for at, kind in due:
            expire(at)
            if kind == self.enter and since is None:
                since = at
                self.handle.registerTimer(at + self.most)
            elif kind == self.leave and since is not None:
                out.append((str(key[0]), since, at, "left"))
                since = None
        expire(now)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if since is None:
            self.since.clear()
        else:
            self.since.update((since,))
        if out:
            yield pd.DataFrame(out, columns=["key", "entered_ms", "ended_ms", "outcome"])

    def close(self) -> None:
        pass


def dwell(stream: DataFrame, key: str, at: str, kind: str, enter: str, leave: str, most_s: int, late: str = "1 hour") -> DataFrame:
    """(key, entered, ended, outcome) of each stay: `left` when an exit came, `expired` after `most_s` without one.

    A re-entry and an exit without an entry count for nothing; of an exit and an entry at one time the exit
    comes first.  State ends with the stay, so it is bounded by the stays that are open.
    """
    rows = stream.withWatermark(at, late).select(F.col(key).cast("string").alias("key"), at, F.unix_millis(F.col(at)).alias("at_ms"), F.col(kind).alias("kind")).where(F.col("kind").isin(enter, leave))
    found = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Dwell(enter, leave, most_s * 1000), outputStructType="key string, entered_ms long, ended_ms long, outcome string", outputMode="Append", timeMode="EventTime")
    return found.select("key", F.timestamp_millis("entered_ms").alias("entered"), F.timestamp_millis("ended_ms").alias("ended"), "outcome")
