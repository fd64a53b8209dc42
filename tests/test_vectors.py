from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.operators import retrieval as R
from factloom.operators import vectors

AS_OF = "2024-03-01 00:00:00"


def some(n=700, dim=12, seed=1):
    """Clustered vectors with ties, vectors without length or of another width, and a null."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(9, dim))[rng.integers(0, 9, n)] + 0.4 * rng.normal(size=(n, dim))
    rows = [(i, x[i].astype(np.float32).tolist()) for i in range(n)]
    rows += [(10_000 + i, [float(v) * 2 for v in rows[i][1]]) for i in range(40)]  # the same direction: ties
    return [*rows, (20_000, [0.0] * dim), (20_001, [1.0]), (20_002, None), (20_003, [float("nan")] * dim), (3, rows[n - 2][1])]


def by_hand(rows, queries, k):
    def unit(v, dim):
        v = np.zeros(dim) if v is None or len(v) != dim else np.array(v, float)
        size = np.sqrt((v * v).sum())
        return v / size if np.isfinite(size) and size > 0 else None

    out = []
    for q, v in queries:
        best, u = {}, unit(v, 12)
        for i, w in rows if u is not None else []:
            w = unit(w, 12)
            if w is not None:
                best[i] = max(best.get(i, -2), round(float(u @ w), 9))
        out += [(q, n + 1, i) for n, (i, _) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def tables(spark, rows, queries):
    return spark.createDataFrame(rows, "message_id long, vector array<float>").repartition(5), spark.createDataFrame(queries, "query_id long, vector array<float>")


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_of_many_queries_equals_brute_force(spark, block):
    rows = some()
    queries = [(i, rows[i][1]) for i in range(0, 40, 2)] + [(900, [0.0] * 12), (901, None)]
    e, q = tables(spark, rows, queries)
    got = vectors.nearest(e, q, 7, block)
    assert sorted((r.query_id, r.rank, r.message_id) for r in got.collect()) == by_hand(rows, queries, 7)


def test_blocks_hold_all_queries_and_no_more_than_asked(spark):
    q = spark.range(103).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("vector")).repartition(4)
    sizes = [b.num_rows for b in vectors.blocks(q, 10)]
    assert sum(sizes) == 103 and max(sizes) <= 10
    assert [b.num_rows for b in vectors.blocks(q.limit(0), 10)] == [0]


def test_many_queries_rank_facts_as_each_alone(spark):
    e, q = tables(spark, some(120), [(i, v) for i, v in some(120)[:6]] + [(99, [0.0] * 12)])
    facts = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("subject_id"), F.lit("likes").alias("predicate"), F.lit("x").alias("object_literal"), (F.col("id") % 7 / 7).alias("confidence"), (F.col("id") % 5 / 5).alias("importance"), F.lit("whatsapp_text").alias("source_type"), F.expr("CASE WHEN id % 4 = 0 THEN array() WHEN id % 4 = 1 THEN array(900000 + id) ELSE array(id % 120, (id * 7) % 120) END").alias("source_message_ids"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + (F.col("id") * 37 % 50) * 1_000_000).alias("last_reinforced"))
    given = {c: F.col(c) for c in facts.columns} | {"first_seen": F.col("last_reinforced"), "decay_rate": F.lit(0.0001), "decay_locked": F.lit(False), "is_correction": F.lit(False)}
    facts = facts.select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in S.EDGES])
    for top, keep in ((3, True), (40, False)):
        got = vectors.relevant_context_many(facts, e, q, AS_OF, top, include_pruned=keep, block=3)
        many = {}
        for r in got.orderBy("query_id", "rank").collect():
            many.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
        for r in q.collect():
            one = R.relevant_context(facts, AS_OF, top, include_pruned=keep, embeddings=e, query=list(r.vector))
            assert many[r.query_id] == [(x.id, round(x.score, 6)) for x in one.collect()], r.query_id


def test_the_index_finds_nine_in_ten_and_all_with_all_cells(spark, tmp_path):
    rows = some(1500)
    e, q = tables(spark, rows, [(i, rows[i][1]) for i in range(0, 1500, 100)])
    cells = vectors.fit_cells(e, 25, sample=400)
    index = vectors.VectorIndex.build(e, cells)
    assert index.rows.count() == len(rows)
    exact = vectors.nearest(e, q)
    probes = vectors.probes_for(index, e, q)
    assert probes < 25 and vectors.recall(index.search(e, q, 10, probes), exact) >= 0.9
    index.save(f"{tmp_path}/index")
    again = vectors.VectorIndex.load(spark, f"{tmp_path}/index")
    assert sorted(map(tuple, again.search(e, q, 10, 25, 40).collect())) == sorted(map(tuple, exact.collect()))


def test_the_index_is_kept_up(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP_ROWS", 20)
    monkeypatch.setattr(vectors, "GROUP_QUERIES", 3)
    rows = some(300)
    e, q = tables(spark, rows, [(i, rows[i][1]) for i in range(0, 60, 6)])
    old = e.filter("message_id % 2 = 0 OR message_id > 9999").unionByName(e.filter("message_id = 5").select("message_id", F.array(*[F.lit(1.0).cast("float")] * 12).alias("vector")))
    index = vectors.VectorIndex.build(old, vectors.fit_cells(old, 6)).add(e.filter("message_id % 2 = 1 AND message_id < 9999"))
    assert index.rows.count() == e.count()
    gone = spark.createDataFrame([(0,), (6,)], "message_id long")
    left = e.join(gone, "message_id", "left_anti")
    got = index.without(gone).search(left, q, 5, 6, 60)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, vectors.nearest(left, q, 5).collect()))
