"""Live windows as a stateful stream.

Messages of a conversation gather in state until the live rule closes the window; a processing-time timer closes it when
nothing has arrived for a while.  Message times decide the rule, arrival times alone the idle close.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from factloom.functions import expr as X
from factloom.operators.windows import LIVE_SECONDS, LIVE_SIZE
from factloom.store import committed

IDLE_SECONDS = 300
OUTPUT = "conversation_id string, window_index long, ids array<string>, closed_by string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LiveWindow:
    """The live rule over one conversation, a message at a time."""

    def __init__(self, size: int = LIVE_SIZE, seconds: int = LIVE_SECONDS, ids: list[str] | None = None, first: int = 0):
        self.size, self.us, self.ids, self.first = size, seconds * 1_000_000, ids or [], first

    def add(self, id_: str, us: int) -> list[str] | None:
        """The window that this message closes, if any; the message then begins the next one."""
        closed = None
        if self.ids and (len(self.ids) >= self.size or us - self.first > self.us):
            closed, self.ids = self.ids, []
        if not self.ids:
            self.first = us
        self.ids.append(id_)
        return closed

    def flush(self) -> list[str] | None:
        closed, self.ids = self.ids or None, []
        return closed


class Windows(StatefulProcessor):
    def __init__(self, size: int = LIVE_SIZE, seconds: int = LIVE_SECONDS, idle: int = IDLE_SECONDS):
        self.size, self.seconds, self.idle = size, seconds, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ids array<string>, first long, index long")

    def _load(self) -> tuple[LiveWindow, int]:
        if not self.open.exists():
            return LiveWindow(self.size, self.seconds), 0
        ids, first, index = self.open.get()
        return LiveWindow(self.size, self.seconds, list(ids), first), index

    def _frame(self, key, rows: list[tuple[int, list[str], str]]) -> pd.DataFrame:
        cols = {"conversation_id": [key[0]] * len(rows), "window_index": [r[0] for r in rows], "ids": [r[1] for r in rows], "closed_by": [r[2] for r in rows]}
        return pd.DataFrame({c: pd.Series(v, dtype="int64" if c == "window_index" else object) for c, v in cols.items()})  # typed also without rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        window, index = self._load()
        got = pd.concat(list(rows)).sort_values(["us", "id"])
        out = []
        for id_, us in zip(got["id"], got["us"], strict=True):
            if closed := window.add(id_, int(us)):
                out.append((index, closed, "rule"))
                index += 1
        self.open.update((window.ids, window.first, index))
        for old in list(self.handle.listTimers()):  # an older timer would close the window too soon
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle * 1000)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        window, index = self._load()
        closed = window.flush()
        self.open.update(([], 0, index + bool(closed)))
        yield self._frame(key, [(index, closed, "idle")] if closed else [])

    def close(self) -> None:
        pass


def live_windows(messages: DataFrame, size: int = LIVE_SIZE, seconds: int = LIVE_SECONDS, idle: int = IDLE_SECONDS) -> DataFrame:
    """Closed windows of a stream of messages.  The session's state store must be PROVIDER."""
    rows = messages.select(F.col("conversation_id").cast("string").alias("conversation_id"), F.col("id").cast("string").alias("id"), X.micros(F.col("timestamp")).alias("us"))
    return rows.groupBy("conversation_id").transformWithStateInPandas(Windows(size, seconds, idle), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime")


def first_seen_only(messages: DataFrame) -> DataFrame:
    """One message for each conversation and external id, for ever; without an external id all."""
    keyed = messages.withColumn("__k", F.coalesce("external_id", F.concat(F.lit("\0"), F.col("id").cast("string"))))
    return keyed.dropDuplicates(["conversation_id", "__k"]).drop("__k")


def drain(query, seconds: float = 30.0) -> bool:
    """Takes in what has arrived, for `seconds` at most, then stops; whether all of it was taken in."""
    done = threading.Thread(target=lambda: _quietly(query.processAllAvailable), daemon=True)
    done.start()
    done.join(seconds)
    whole = not done.is_alive()
    query.stop()
    return whole


def _quietly(f) -> None:
    try:
        f()
    except Exception:  # noqa: BLE001 - the query was stopped before all was taken in
        pass


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows that a stopped query left open, as its other windows: closed_by is `shutdown`.  Their messages count as
    processed only once the caller has done so; until then recovery finds them."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    return state.select(F.col("key.conversation_id").alias("conversation_id"), F.col("value.index").alias("window_index"), F.col("value.ids").alias("ids"), F.lit("shutdown").alias("closed_by")).filter(F.size("ids") > 0)


class Intake:
    """A sink for writeStream.foreachBatch that tries again, and an intake gate.

    store(batch, number) stores one micro-batch.  A failure is tried `attempts` times, with waits that double; then the batch fails
    and the stream with it, so that it is read again after a restart.  Batches that were stored before are known by their
    number and left out.  stored() tells the last number that lies with the data, and is asked once, at the start: after a
    restart a batch that was stored is then left out too.  Without it only this object remembers, and store must be idempotent.
    After close() nothing more is let in; wait() tells whether what was under way has ended in time.
    """

    def __init__(self, store: Callable[[DataFrame, int], None], attempts: int = 3, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep, stored: Callable[[], int | None] | None = None):
        self.store, self.attempts, self.pause, self.sleep = store, attempts, wait, sleep
        self.forwarded = self.duplicates = self.retries = self.failed = 0
        last = stored() if stored else None
        self.last, self.open, self.idle = -1 if last is None else last, True, threading.Event()
        self.idle.set()

    def __call__(self, batch: DataFrame, number: int) -> None:
        if not self.open:
            raise RuntimeError("intake closed")
        if number <= self.last:
            self.duplicates += 1
            return
        self.idle.clear()
        try:
            for k in range(self.attempts):
                try:
                    self.store(batch, number)
                    self.forwarded, self.last = self.forwarded + 1, number
                    return
                except Exception:
                    if k == self.attempts - 1:
                        self.failed += 1
                        raise
                    self.retries += 1
                    self.sleep(self.pause * 2**k)
        finally:
            self.idle.set()

    def close(self) -> None:
        self.open = False

    def wait(self, seconds: float) -> bool:
        return self.idle.wait(seconds)


def numbered_store(folder: str) -> tuple[Callable[[DataFrame, int], None], Callable[[SparkSession], int | None]]:
    """store and stored for an Intake that writes each batch to a folder of its number: a folder whose write came to its end is
    the mark, so data and number are committed at once, and a batch that was cut off is written anew."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    def stored(spark: SparkSession) -> int | None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n[6:]) for n in names if n.startswith("batch=") and committed(spark, f"{folder}/{n}")), default=None)

    return store, stored
