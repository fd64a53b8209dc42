"""When to consolidate, as a stateful stream: after a quiet stretch, or when the last run is too long ago.

The rule is that of `analytics.idle_points`, over event time: a watermark says up to when all activity is known, and timers fire
the runs that are due by then.  `Consolidator` is the sink that starts runs and cancels one under way when something arrives.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

IDLE_SECONDS, LONGEST_SECONDS = 35 * 60, 20 * 3600
IDLE, FALLBACK, ACTIVITY = "idle_threshold", "max_interval_fallback", "activity"
OUTPUT = "at long, reason string"


@dataclass
class Rule:
    """The rule, over one series of seconds.  activity: the last one; run: the last run; done: whether the stretch had a run."""

    idle: int
    longest: int
    activity: int
    run: int
    done: bool = False

    def due(self) -> tuple[int, str]:
        """The next run, if nothing happens before."""
        quiet = self.activity + self.idle
        return (self.run + self.longest, FALLBACK) if self.done or self.run + self.longest < quiet else (quiet, IDLE)

    def upto(self, second: int) -> Iterator[tuple[int, str]]:
        """The runs that are due up to a second, that one included, if nothing happens before."""
        while self.due()[0] <= second:
            found = self.due()
            self.run, self.done = found[0], True
            yield found

    def seen(self, second: int) -> Iterator[tuple[int, str]]:
        """Something happens: the runs that were due by then."""
        yield from self.upto(second)
        self.activity, self.done = max(self.activity, second), False


def _thinned(seconds: list[int], idle: int) -> list[int]:
    """The first and last second of each spell of `idle` seconds: all that the rule asks for."""
    low: dict[int, int] = {}
    high: dict[int, int] = {}
    for s in seconds:
        k = s // idle
        low[k], high[k] = min(low.get(k, s), s), max(high.get(k, s), s)
    return sorted({*low.values(), *high.values()})


class _Trigger(StatefulProcessor):
    def __init__(self, idle: int, longest: int, start: int | None):
        self.idle, self.longest, self.start = idle, longest, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rule = handle.getValueState("rule", "activity long, run long, done boolean")
        self.waiting = handle.getValueState("waiting", "seconds array<long>")

    def _step(self, new: list[int], watermark: int) -> list[tuple[int, str]]:
        """Takes in what the watermark has passed; the rest waits, two seconds for each spell of it."""
        waiting = _thinned([*(self.waiting.get()[0] if self.waiting.exists() else []), *new], self.idle)
        ready, out = [s for s in waiting if s <= watermark], []
        rule = Rule(self.idle, self.longest, *self.rule.get()) if self.rule.exists() else None
        if rule is None and (ready or (self.start is not None and self.start <= watermark)):
            first = ready[0] if self.start is None else self.start
            rule = Rule(self.idle, self.longest, first, first)
        if rule is not None:
            for s in ready:
                if s >= (self.start or s):
                    out += rule.seen(s)
            out += rule.upto(watermark)
            self.rule.update((rule.activity, rule.run, rule.done))
        self.waiting.update(([s for s in waiting if s > watermark],))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        at = [s for s in waiting if s > watermark][:1] + ([rule.due()[0]] if rule is not None else [])
        if at:
            self.handle.registerTimer(min(at) * 1000)
        return out

    def _frame(self, rows: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"at": pd.Series([r[0] for r in rows], dtype="int64"), "reason": pd.Series([r[1] for r in rows], dtype=object)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seconds = [int(s) for r in rows for s in r["second"]]
        runs = self._step(seconds, timerValues.getCurrentWatermarkInMs() // 1000)
        yield self._frame([(max(seconds), ACTIVITY), *runs])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(self._step([], timerValues.getCurrentWatermarkInMs() // 1000))

    def close(self) -> None:
        pass


def consolidation_runs(messages: DataFrame, idle: int = IDLE_SECONDS, longest: int = LONGEST_SECONDS, late: str = "1 minute", start: int | None = None) -> DataFrame:
    """A stream of messages (timestamp) as a stream of what happens: at (seconds since 1970) and reason.

    reason is `idle_threshold` or `max_interval_fallback` for a run that is due, or `activity` (the last second of what came) once for
    each micro-batch with messages.  A message later than `late` behind the newest one doesn't count; null time stamps don't
    either.  Each task thins its messages to two seconds for each spell of `idle` before they meet in the one series, whose state
    is three numbers and what the watermark hasn't passed.  The session's state store must be live_windows.PROVIDER.
    """

    def thin(batches):
        for b in batches:
            for key, rows in b.assign(spell=b["second"] // idle).groupby("spell"):
                yield pd.DataFrame({"time": [rows["time"].min(), rows["time"].max()]})

    second = F.floor(F.unix_micros(F.col("timestamp").cast("timestamp")) / 1_000_000).cast("long")
    rows = messages.filter(F.col("timestamp").isNotNull()).select(F.col("timestamp").cast("timestamp").alias("time"), second.alias("second"))
    thinned = rows.mapInPandas(thin, "time timestamp").withWatermark("time", late)
    one = thinned.select(F.lit(1).alias("one"), "time", F.floor(F.unix_micros("time") / 1_000_000).cast("long").alias("second"))
    return one.groupBy("one").transformWithStateInPandas(_Trigger(idle, longest, start), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


class Consolidator:
    """The sink of `consolidation_runs`: starts a run, one at a time, and cancels it when something arrives while it goes on.

    run: gets the reason and an event that is set when the run is cancelled; it should then stop.  A run that is due while
    another one goes on is left out.  log gets (reason, outcome) of each run: finished, cancelled or failed.
    """

    def __init__(self, run: Callable[[str, threading.Event], None]):
        self.run, self.log = run, []
        self._lock, self._cancel, self._thread = threading.Lock(), threading.Event(), None

    def busy(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def on(self, reason: str) -> None:
        with self._lock:
            if reason == ACTIVITY:
                if self.busy():
                    self._cancel.set()
            elif not self.busy():
                cancel = self._cancel = threading.Event()
                self._thread = threading.Thread(target=self._go, args=(reason, cancel), daemon=True)
                self._thread.start()

    def _go(self, reason: str, cancel: threading.Event) -> None:
        try:
            self.run(reason, cancel)
            outcome = "cancelled" if cancel.is_set() else "finished"
        except Exception:  # noqa: BLE001 - a run that fails must not stop the stream
            outcome = "cancelled" if cancel.is_set() else "failed"
        self.log.append((reason, outcome))

    def batch(self, rows: DataFrame, _id: int = 0) -> None:
        """For foreachBatch: activity cancels first, then the last run of the batch is started; earlier ones are out of date."""
        got = sorted((r.at, r.reason) for r in rows.groupBy("reason").agg(F.max("at").alias("at")).collect())
        for reason in [r for _, r in got if r == ACTIVITY] + [r for _, r in got if r != ACTIVITY][-1:]:
            self.on(reason)

    def wait(self, seconds: float = 30.0) -> None:
        if self._thread is not None:
            self._thread.join(seconds)
