from __future__ import annotations

import datetime as dt
import random
import time

import pytest

from factloom.operators.windows import live_windows as batch_windows
from factloom.streaming import live_windows as L

T0 = dt.datetime(2024, 2, 1)
SCHEMA = "id string, conversation_id string, timestamp timestamp, external_id string"


def rows():
    rng, out = random.Random(2), []
    for c in "ab":
        at = 0
        for k in range(40):
            at += rng.choice([5, 100, 301, 700])
            out.append((f"{c}{k:03d}", c, T0 + dt.timedelta(seconds=at), None))
    return out


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.PROVIDER)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = L.live_windows(stream).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r.ids) for r in spark.table("closed").collect()}
    want: dict = {}
    for r in batch_windows(df).orderBy("timestamp", "id").collect():
        want.setdefault((r.conversation_id, r.window_index), []).append(r.id)
    last = {c: max(i for k, i in want if k == c) for c in "ab"}
    assert got == {tuple(v) for (c, i), v in want.items() if i < last[c]}  # the last window of each is still open
    left = L.open_windows(spark, f"{tmp_path}/cp").collect()
    assert {(r.conversation_id, r.window_index, tuple(r.ids)) for r in left} == {(c, last[c], tuple(want[c, last[c]])) for c in "ab"}


def test_first_message_of_a_key_stays(spark, tmp_path):
    data = [("1", "a", T0, "x"), ("2", "a", T0, "x"), ("3", "a", T0, None), ("4", "a", T0, None), ("5", "b", T0, "x")]
    assert L.first_seen_only(spark.createDataFrame(data, SCHEMA)).count() == 4


def test_flush_and_open_windows():
    w = L.LiveWindow()
    assert w.flush() is None
    assert w.add("a", 0) is None and w.add("b", -5) is None and w.flush() == ["a", "b"]
    assert w.add("c", 0) is None and w.add("d", 300_000_001) == ["c"]


def test_the_timer_closes_an_idle_window(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.PROVIDER)
    spark.createDataFrame([("1", "a", T0, None), ("2", "a", T0, None)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = L.live_windows(stream, idle=1).writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 120
        while time.time() < end and not spark.table("timed").count():
            time.sleep(1)
        assert [(r.ids, r.closed_by) for r in spark.table("timed").collect()] == [(["1", "2"], "idle")]
    finally:
        L.drain(q, 5)
    assert not q.isActive


def test_intake_tries_again_and_closes():
    calls, waits = [], []

    def store(batch, number):
        calls.append(number)
        if len(calls) in (1, 2) or number == 9:
            raise OSError

    sink = L.Intake(store, attempts=3, wait=0.5, sleep=waits.append)
    sink("rows", 0)
    sink("rows", 0)
    assert (calls, waits, sink.forwarded, sink.retries, sink.duplicates) == ([0, 0, 0], [0.5, 1.0], 1, 2, 1)
    with pytest.raises(OSError):
        sink("rows", 9)
    sink.close()
    with pytest.raises(RuntimeError, match="closed"):
        sink("rows", 10)
    assert sink.failed == 1 and sink.wait(0)


def test_a_restarted_intake_leaves_out_what_was_stored(spark, tmp_path):
    folder = f"{tmp_path}/out"
    store, stored = L.numbered_store(folder)
    batch = spark.createDataFrame([("1", "a", T0, None)], SCHEMA)
    first = L.Intake(store, stored=lambda: stored(spark))
    first(batch, 0)
    first(batch, 1)
    again = L.Intake(store, stored=lambda: stored(spark))
    for n in (0, 1, 2):
        again(batch, n)
    assert (again.duplicates, again.forwarded) == (2, 1) and spark.read.parquet(folder).count() == 3
