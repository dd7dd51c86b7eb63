"""Alerts as a keyed state with timers: one when a key's HIGH reports of the last hours reach the threshold, and none
again until they have fallen below it.

Reports wait in the state until the watermark has passed them, so that late and unordered ones are judged in the order
of their times; then each moment is taken in turn: reports that have left the window go, those of the moment come, and
the count decides. A moment after which the count can only fall has a timer too, so a key that has become quiet is
armed again without a further report, and leaves no state behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed states with timers need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTPUT = "key string, at long, n long"


@contextmanager
def state_store(spark):
    """The session with the state store of STATE_STORE for a while."""
    old = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        yield spark
    finally:
        spark.conf.set(STATE_STORE[0], old)


def crossings(times: np.ndarray, counts: np.ndarray, after: int, upto: int, window: int, threshold: int, armed: bool):
    """Takes in order the moments after `after` up to `upto` at which the number of reports in the window changes: where
    reports come (times, sorted, and counts) and where they leave it. Returns the alerts (time, number) and whether the
    key is armed at the end. All times in milliseconds."""
    moments = np.unique(np.concatenate([times, times + window]))
    moments = moments[(moments > after) & (moments <= upto)]
    total = np.concatenate([[0], np.cumsum(counts)])
    inside = total[np.searchsorted(times, moments, side="right")] - total[np.searchsorted(times, moments - window, side="right")]
    alerts = []
    for now, n in zip(moments.tolist(), inside.tolist()):
        if n < threshold:
            armed = True
        elif armed:
            alerts.append((now, n))
            armed = False
    return alerts, armed


class CrossingAlerts(StatefulProcessor):
    """State, one value for each key: reports by time (those in the window and those that wait), the time up to which
    moments have been taken, the next moment (for which there is a timer), and whether the key is armed."""

    def __init__(self, window_hours: int, threshold: int):
        self.window, self.threshold = window_hours * 3_600_000, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("reports", "times array<long>, counts array<long>, done long, next long, armed boolean")

    def _held(self):
        s = self.state.get() if self.state.exists() else ([], [], -1, -1, True)
        return dict(zip(map(int, s[0]), map(int, s[1]))), int(s[2]), int(s[3]), bool(s[4])

    def _hold(self, held: dict, done: int, planned: int, armed: bool) -> None:
        """Keeps the state, with a timer for the next moment after done; a key without reports leaves nothing behind."""
        following = min((m for t in held for m in (t, t + self.window) if m > done), default=-1)
        if planned != following:
            if planned >= 0:
                self.handle.deleteTimer(planned)
            if following >= 0:
                self.handle.registerTimer(following)
        if held:
            times = sorted(held)
            self.state.update((times, [held[t] for t in times], done, following, armed))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, done, planned, armed = self._held()
        done = max(done, timerValues.getCurrentWatermarkInMs() - 1 if not held else done)
        for frame in rows:
            for at, n in frame.groupby("at").size().items():
                if at > done:  # else later than the watermark allows
                    held[int(at)] = held.get(int(at), 0) + int(n)
        self._hold(held, done, planned, armed)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, done, planned, armed = self._held()
        upto = timerValues.getCurrentWatermarkInMs()
        times = np.array(sorted(held), np.int64)
        alerts, armed = crossings(times, np.array([held[t] for t in times.tolist()], np.int64), done, upto, self.window, self.threshold, armed)
        held = {t: n for t, n in held.items() if t + self.window > upto}
        self._hold(held, upto, -1, armed)
        yield pd.DataFrame([(str(key[0]), t, n) for t, n in alerts], columns=["key", "at", "n"])

    def close(self) -> None:
        pass


def alert_crossings(stream: DataFrame, key: str | None = None, window_hours: int = 24, threshold: int = 10, late: str = "1 hour") -> DataFrame:
    """key, event, fired_at, n, window_hours, threshold: alerts by key (a column; null values are the key 'unknown'; none:
    one key, 'all') of a stream with timestamp and risk_level, for the hours up to and with each moment. threshold from
    1 on. Needs the state store that STATE_STORE names."""
    if threshold < 1 or window_hours < 1:
        raise ValueError("threshold and window_hours must be at least 1")
    k = F.coalesce(F.col(key).cast("string"), F.lit("unknown")) if key else F.lit("all")
    high = stream.where("risk_level = 'HIGH'").select("timestamp", k.alias("key"), F.unix_millis("timestamp").alias("at")).withWatermark("timestamp", late)
    fired = high.groupBy("key").transformWithStateInPandas(statefulProcessor=CrossingAlerts(window_hours, threshold), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime")
    whole = lambda v, name: F.lit(v).cast("long").alias(name)
    return fired.select("key", F.lit("high_risk_alert").alias("event"), F.timestamp_millis("at").alias("fired_at"), "n", whole(window_hours, "window_hours"), whole(threshold, "threshold"))
