from __future__ import annotations

import datetime as dt
import random
import threading

import pytest

from factloom.operators import analytics as A
from factloom.streaming import consolidation as C
from factloom.streaming.live_windows import PROVIDER

T0 = dt.datetime(2024, 2, 1)
BASE = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
SCHEMA = "id long, timestamp timestamp"


@pytest.mark.parametrize("seed", range(40))
def test_the_rule_equals_itself_second_by_second(seed):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(1, 900), rng.randint(1, 60)))
    rule, got = C.Rule(30, 71, 0, 0), []
    for t in C._thinned(times, 30):
        got += rule.seen(t)
    got += rule.upto(1000)
    activity = run = 0
    done, want = False, []
    for now in range(1001):
        if now - activity >= 30 and not done:
            want.append((now, C.IDLE))
            run, done = now, True
        elif now - run >= 71:
            want.append((now, C.FALLBACK))
            run, done = now, True
        if now in times:
            activity, done = now, False
    assert got == want


def test_the_stream_fires_both_runs_and_equals_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rng, at, rows = random.Random(3), 0, []
    for k in range(120):
        at += rng.choice([5, 20, 40, 130] if k % 40 > 20 else [9, 14])
        rows.append((k, T0 + dt.timedelta(seconds=at)))
    rows.append((999, T0 + dt.timedelta(seconds=at + 5000)))  # the watermark passes all before it
    shuffled = [r for i in range(0, len(rows), 6) for r in rng.sample(rows[i : i + 6], len(rows[i : i + 6]))]
    for n, i in enumerate(range(0, len(rows), 24)):
        spark.createDataFrame(shuffled[i : i + 24], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n:02d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = C.consolidation_runs(stream, 60, 97, late="20 minutes")
    q = out.writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.at, r.reason) for r in spark.table("runs").collect() if r.reason != C.ACTIVITY)
    until = T0 + dt.timedelta(seconds=at + 5000 - 1200)  # the last watermark
    want = sorted((r.at, r.reason) for r in A.idle_points(spark.createDataFrame(rows, SCHEMA), 60, 97, until=str(until)).collect())
    assert {r for _, r in want} == {C.IDLE, C.FALLBACK}
    assert [g for g in got if g[0] < BASE + at + 3800] == [w for w in want if w[0] < BASE + at + 3800]
    assert all(g[0] <= BASE + at + 3800 for g in got)


def test_what_arrives_cancels_a_run_under_way():
    started = threading.Event()

    def run(reason, cancel):
        started.set()
        assert cancel.wait(20)

    sink = C.Consolidator(run)
    sink.on(C.IDLE)
    assert started.wait(20) and sink.busy()
    sink.on(C.FALLBACK)  # one at a time
    sink.on(C.ACTIVITY)
    sink.wait()
    assert sink.log == [(C.IDLE, "cancelled")]
    done = C.Consolidator(lambda reason, cancel: None)
    done.on(C.ACTIVITY)
    done.on(C.FALLBACK)
    done.wait()
    assert done.log == [(C.FALLBACK, "finished")]


def test_the_last_run_of_a_batch_is_started(spark):
    seen = []
    sink = C.Consolidator(lambda reason, cancel: seen.append(reason))
    sink.batch(spark.createDataFrame([(5, C.IDLE), (9, C.FALLBACK), (7, C.ACTIVITY)], C.OUTPUT))
    sink.wait()
    assert seen == [C.FALLBACK]
