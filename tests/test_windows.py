from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import windows as W


def by_hand(rows, size, seconds):
    out, state = {}, {}
    for c, us, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        index, n, first = state.get(c, (-1, size, 0))
        if n >= size or us - first > seconds * 1_000_000:
            index, n, first = index + 1, 0, us
        state[c] = (index, n + 1, first)
        out[i] = index
    return out


@pytest.mark.parametrize(("seed", "size", "seconds", "parts"), [(1, 10, 300, "4"), (2, 4, 20, "9"), (3, 1, 5, "5"), (4, 30, 10_000, "8")])
def test_one_busy_conversation_is_numbered_over_many_partitions(spark, seed, size, seconds, parts):
    rng, rows, at = random.Random(seed), [], 0
    for i in range(1500):
        at += rng.choice([0, 1, 5, 19, 20, 21, 60, 301]) * 1_000_000
        rows.append(("busy" if rng.random() < 0.9 else rng.choice("abyz"), at, i))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conversation_id string, us long, id long").withColumn("timestamp", F.timestamp_micros("us")).repartition(3)
        got = W.live_windows(df, size=size, seconds=seconds)
        assert {r.id: r.window_index for r in got.collect()} == by_hand(rows, size, seconds)
        assert got.columns == [*df.columns, "window_index"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


@pytest.mark.parametrize("seed", range(30))
def test_pieces_put_together_equal_the_sequence_at_every_split(seed):
    rng = random.Random(seed)
    size, limit = rng.choice([1, 3, 10]), rng.choice([0, 5, 40])
    times = np.cumsum([rng.choice([0, 1, 4, 6, 41]) for _ in range(60)]).astype(np.int64)
    starts, at = [0], 0
    while (after := int(W.Piece(times).starts(size, limit)[at])) < len(times):
        starts.append(after)
        at = after
    assert W.walked(times, [0], size, limit) == {0: (len(starts) - 1, starts[-1])}
    for cut in range(1, 60):
        n, last = W.walked(times[:cut], [0], size, limit)[0]
        lead = max(0, cut - size)
        after = W.Piece(times[lead:]).starts(size, limit)
        entries = [c for c in range(cut - lead) if after[c] >= cut - lead]
        assert last - lead in entries
        more, end = W.walked(times[lead:], entries, size, limit)[last - lead]
        assert (n + more, end + lead) == (len(starts) - 1, starts[-1])


def test_no_messages(spark):
    df = spark.createDataFrame([], "conversation_id string, timestamp timestamp, id long")
    assert W.live_windows(df).count() == 0
