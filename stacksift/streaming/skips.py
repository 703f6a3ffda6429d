"""Keys that could not be parsed are left alone for some days: a keyed state with a timer over a stream of attempts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, time, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAYS = 7
COLUMNS = "attempt bigint, decision string, times int, first_failed date, last_failed date"


@contextmanager
def state_store(spark: SparkSession):
    """State with several columns and timers needs the store on disk; a stream keeps the one that it was started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class _Skips(StatefulProcessor):
    def __init__(self, key: str, days: int):
        self.key, self.wait = key, timedelta(days=days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "first date, last date, times int")
        self.failures = handle.getMapState("failures", "day date", "times int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        # each call on state or timers is a message to the store, so a key pays only for those that change something
        frames = list(rows)
        attempts = frames[0] if len(frames) == 1 else pd.concat(frames)
        attempts = attempts.iloc[np.lexsort((attempts["attempt"].to_numpy(), attempts["at"].to_numpy()))]
        entry = self.entry.get()
        first, last, times = entry or (None, None, 0)
        until = self._end(last)
        out, failed, kept = [], {}, entry is not None
        for attempt, at, outcome in zip(attempts["attempt"].tolist(), attempts["at"].tolist(), attempts["outcome"].tolist(), strict=True):
            if last is not None and at.replace(tzinfo=None) < until:
                decision = "skipped"
            elif outcome == "bad":
                decision, last = "failed", at.date()
                first, times, until = first or last, times + 1, self._end(last)
                failed[last] = failed.get(last, 0) + 1
            elif outcome == "ok":
                decision, first, last, times = "ok", None, None, 0
                failed, kept = {}, False
            else:
                decision = "error"  # the fetch failed, which says nothing about the page
            out.append((attempt, decision, times, first, last))
        if entry and not kept:
            self.failures.clear()
        if last is not None:
            if (first, last, times) != entry:
                self.entry.update((first, last, times))
            for day, n in failed.items():
                known = self.failures.getValue((day,))[0] if kept and self.failures.containsKey((day,)) else 0
                self.failures.updateValue((day,), (known + n,))
        elif entry:
            self.entry.clear()
        self._wake(last, entry and entry[1])
        yield self._rows(key, out)

    def _end(self, last) -> datetime | None:
        return None if last is None else datetime.combine(last, time.min) + self.wait

    def _wake(self, last, before) -> None:
        """One timer, at the day from which the key may be tried again; keys without an entry have none."""
        if before is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if last is not None:
            self.handle.registerTimer(int(self._end(last).replace(tzinfo=timezone.utc).timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        entry = self.entry.get()
        if entry:
            first, last, times = entry
            yield self._rows(key, [(None, "due", times, first, last)])

    def _rows(self, key, rows: list) -> pd.DataFrame:
        attempt, decision, times, first, last = zip(*rows, strict=True)
        made = {self.key: [key[0]] * len(rows), "attempt": pd.array(attempt, dtype="Int64"), "decision": decision, "times": np.array(times, np.int32), "first_failed": first, "last_failed": last}
        return pd.DataFrame(made)

    def close(self) -> None:
        pass


def skip_list(attempts: DataFrame, key: str, days: int = DAYS, late: str = "0 seconds") -> DataFrame:
    """What became of each attempt (key, attempt, at, outcome: bad, ok or error), in the order of time.

    A key whose page could not be parsed goes on the list: attempts before the end of ``days`` days from the day of the
    last failure are skipped, a later one is made, success takes the key off, a failed fetch changes nothing. Rows are
    key, attempt, decision (skipped, failed, ok, error), and the entry behind it: times, first_failed, last_failed. When the
    stream's time has passed the end of the wait, a row without an attempt says that the key is due.

    Within a batch the attempts of one key are sorted in memory; bound a batch with ``maxFilesPerTrigger``.
    """
    spark = attempts.sparkSession
    kind = dict(attempts.dtypes)[key]
    timed = attempts.select(key, "attempt", F.col("at").cast("timestamp").alias("at"), "outcome").withWatermark("at", late)
    with state_store(spark):
        return timed.groupBy(key).transformWithStateInPandas(_Skips(key, days), f"{key} {kind}, {COLUMNS}", "Append", "EventTime")
