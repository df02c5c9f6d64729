"""Failed logins of each user in event time, with keyed state and timers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_COLUMNS = ["id", "username", "ts", "failures_before", "locked"]
_OUT = "id long, username string, ts timestamp, failures_before long, locked boolean"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Lockouts(StatefulProcessor):
    """State of a user: attempts that the watermark has not passed, and failures of one window behind
    it. A timer at the earliest of them wakes the user; what the watermark has passed is judged in the
    order of its time, and what no window reaches any more is dropped."""

    def __init__(self, window_us: int, limit: int, reset: bool):
        self.window_us, self.limit, self.reset = window_us, limit, reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, success boolean")
        self.failures = handle.getListState("failures", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            us = part["us"].astype("int64").tolist()
            self.waiting.appendList(list(zip(us, part["id"].astype("int64").tolist(), part["success"].astype(bool).tolist())))
            earliest = min([*us, *([] if earliest is None else [earliest])])
        if earliest is not None:
            self._wake(earliest)
        yield pd.DataFrame(columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        ready, rest = [r for r in waiting if r[0] <= passed], [r for r in waiting if r[0] > passed]
        out, failures = self._judged(ready, deque(sorted(r[0] for r in self.failures.get())))
        last = min(passed, rest[0][0]) if rest else passed
        failures = [f for f in failures if f >= last - self.window_us]
        for state, values in ((self.waiting, rest), (self.failures, [(f,) for f in failures])):
            state.clear()
            if values:
                state.put(values)
        if rest:
            self._wake(rest[0][0], passed)
        elif failures:
            self._wake(failures[-1] + self.window_us + 1000, passed)
        ids, us, before, locked = ([r[k] for r in out] for k in range(4))
        yield pd.DataFrame({"id": ids, "username": key[0], "ts": pd.to_datetime(pd.Series(us, dtype="int64"), unit="us"), "failures_before": before, "locked": locked}, columns=_COLUMNS)

    def _judged(self, ready: list, failures: deque) -> tuple[list, deque]:
        out, at = [], 0
        while at < len(ready):
            us = ready[at][0]
            while failures and failures[0] < us - self.window_us:
                failures.popleft()
            end = at
            while end < len(ready) and ready[end][0] == us:
                end += 1
            peers = ready[at:end]
            if self.reset:
                for _, i, ok in peers:
                    out.append((i, us, len(failures), len(failures) >= self.limit))
                    if ok:
                        failures.clear()
                    else:
                        failures.append(us)
            else:
                # attempts of one moment see each other
                failures.extend(us for _, _, ok in peers if not ok)
                out.extend((i, us, n, n >= self.limit) for _, i, ok in peers for n in [len(failures) - (not ok)])
            at = end
        return out, failures

    def _wake(self, us: int, passed: int = -1) -> None:
        """One timer a user: the earliest that is asked for. Timers that have passed are firing now."""
        ms, own = -(-us // 1000), [t for (t,) in _timers(self.handle) if t * 1000 > passed]
        if not own or ms < min(own):
            for t in own:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


def _timers(handle: StatefulProcessorHandle) -> list[tuple[int]]:
    return [t if isinstance(t, tuple) else (t,) for t in handle.listTimers()]


def lockouts(attempts: DataFrame, window_s: int = 900, limit: int = 5, late: str = "10 minutes", reset: bool = False) -> DataFrame:
    """id, username, ts, failures_before and locked of every attempt of a stream (id, username, ts,
    success), for append mode: the failures of its user in the seconds before it, itself left out.

    Attempts may come in any order within late: they wait for the watermark and are then judged by
    their time, so the rows are those of lockout_history over the same log. Later ones are dropped.
    With reset, a success clears the failures before it, and attempts of one moment follow each other
    by id. Rows without user or time are left out. State is a user's attempts within late and failures
    within the window, and goes with its last timer. Keyed state lives in RocksDB, which this sets for
    the session.
    """
    attempts.sparkSession.conf.set(*_PROVIDER)
    rows = attempts.where("username IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = rows.select("username", "ts", F.col("id").cast("long").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.coalesce("success", F.lit(False)).alias("success"))
    return rows.groupBy("username").transformWithStateInPandas(_Lockouts(window_s * 1_000_000, limit, reset), outputStructType=_OUT, outputMode="append", timeMode="eventTime")
