from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import mixing, sharding, topk

DOCS = "doc_id long, text string, source string, shard int, size string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 99, "clash") for i, t, s in rows], DOCS)


def test_shards_are_contiguous_and_near_equal(spark):
    rows = [(i, "ü" * (i * 37 % 211), None) for i in range(500)] + [(None, None, None), (3, "again", None), (3, "again", None)]
    got = sharding.shard_by_bytes(docs(spark, rows).repartition(5), 7).toPandas()
    assert len(got) == len(rows)
    assert sorted(got["size"]) == sorted(len((t or "").encode()) + 16 for _, t, _ in rows)
    assert set(got.text_crc32) == {zlib.crc32((t or "").encode()) for _, t, _ in rows}
    share = got["size"].sum() / 7
    for shard, part in got.groupby("shard"):
        assert abs(part["size"].sum() - share) < 2 * got["size"].max()
        assert sorted(part.slot) == list(range(len(part)))
    assert got.grown_shard.isna().all() and set(got.law) == {"bytes"}


def test_shards_equal_a_plain_walk_and_keep_equal_texts_together(spark):
    rows = [(i, f"text {i % 40} " + "x" * (i % 40 * 30), None) for i in range(300)] + [(None, None, None), (300, "", None), (301, "long " * 20_000, None)]
    got = sharding.shard_by_bytes(docs(spark, rows).repartition(6), 9).toPandas()
    text = {i: t or "" for i, t, _ in rows if i is not None}
    got["text"] = ["" if math.isnan(i) else text[int(i)] for i in got.doc_id]
    order = got.sort_values(["shard", "slot"])
    runs = 1 + (order.text.to_numpy()[1:] != order.text.to_numpy()[:-1]).sum()
    assert runs == order.text.nunique()  # equal texts are neighbours, and go by id
    for _, part in order.groupby("text"):
        assert part.doc_id.dropna().is_monotonic_increasing and part["size"].nunique() == 1
    total, at = int(order["size"].sum()), 0
    for size, shard in zip(order["size"], order.shard, strict=True):  # the shard in whose share the row's middle lies
        assert shard == min((2 * at + size) * 9 // (2 * total), 8)
        at += size


def test_one_id_with_most_rows_is_dealt_over_shards(spark):
    got = sharding.shard_by_bytes(docs(spark, [(7, "same", None)] * 300 + [(i, "x", None) for i in range(30)]), 10).toPandas()
    assert got.groupby("shard")["size"].sum().std() < 40


def test_sharding_of_an_empty_table(spark):
    assert sharding.shard_by_bytes(docs(spark, []), 4).count() == 0


def test_targets_reshare_what_small_sources_cannot_fill():
    t = mixing.targets({"a": 1, "b": 100, "c": 100, None: 0})
    assert t["a"] == 3 and t[None] == 0 and t["b"] + t["c"] + 3 == pytest.approx(201)
    assert t["b"] / 2 == pytest.approx(t["c"] / 3)
    assert mixing.targets({}) == {}


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text("abc", max_size=2), st.integers(0, 1000), max_size=6))
def test_targets_share_everything_within_limits(sizes):
    t = mixing.targets(sizes)
    assert sum(t.values()) == pytest.approx(sum(sizes.values()))
    assert all(t[s] <= 3 * n + 1e-6 for s, n in sizes.items())


def test_mix_meets_targets_and_agrees_on_rerun(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("w" * n), s) for i, (n, s) in enumerate(zip(rng.integers(0, 60, 400), rng.choice(["a", "b", "c", None], 400, p=[0.7, 0.1, 0.1, 0.1]), strict=True))]
    rows += [(None, None, "a"), (5, "", "b"), (5, "x\x1cy z", "b"), (9, "a b", "c"), (9, "a b", "c")]
    df = docs(spark, rows)
    got, again = (mixing.mix(x).toPandas() for x in (df, df.repartition(7)))
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(repr, got[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))
    count = defaultdict(int)
    for _, t, s in rows:
        count[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for source, part in got.groupby("source", dropna=False):
        s = source if isinstance(source, str) else None
        assert part.source_size.iloc[0] == count[s]
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max()
    assert (got.taken <= 3 * got["size"]).all()
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == got.copies.sum()
    assert mixing.mix(docs(spark, [])).count() == 0


def brute_top(vectors, k):
    v = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in vectors if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (i, e) in enumerate(v):
        if i % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(e, f, strict=False)), j) for b, (j, f) in enumerate(v) if b != a)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [topk.QUERY_BLOCK, 3])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.3, 8), 2)]) for i in range(160)]
    rows += [(200 + i, [0.0] * 5 + [0.5]) for i in range(40)]  # ties, and shorter vectors
    rows += [(20, rows[3][1]), (40, rows[40][1]), (None, [1.0]), (300, None), (320, [float("nan")]), (340, [None, 1.0]), (360, []), (380, [math.inf])]
    df = spark.createDataFrame([(i, e, 1, 2.0) for i, e in rows], "vec_id long, embedding array<float>, rank int, score double").repartition(5)
    got = sorted(map(tuple, topk.top_k(df, F.col("id") % 20 == 0).collect()))
    assert got == brute_top(rows, 20)


def test_top_k_of_an_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_scattered_scores_are_inner_products(seed):
    rng = np.random.default_rng(seed)
    q, c = (rng.integers(-9, 9, (n, 6)) * (rng.random((n, 6)) < 0.4) for n in (5, 9))
    assert (topk.scatter_scores(q, c) == q @ c.T).all()


def test_large_components_keep_their_value(spark):
    df = spark.createDataFrame([(20, [2.0, 0.0]), (1, [2e6, 1.0]), (2, [3e6, 0.0]), (3, [1e12, -1e12])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("id") == 20).orderBy("rank").collect()]
    assert got == [(20, 1, 3, 128 * 64 * 10**12), (20, 2, 2, 128 * 64 * 3 * 10**6), (20, 3, 1, 128 * 64 * 2 * 10**6)]
    q, c = np.array([[1 << 40, -(1 << 40)], [3, 0]]), np.array([[1 << 40, (1 << 40) - 1], [1 << 40, 0]])
    assert topk.scatter_scores(q, c).tolist() == [[1 << 40, topk.MOST], [3 << 40, 3 << 40]]
