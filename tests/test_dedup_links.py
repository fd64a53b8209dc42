from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.operators import dedup, mutations
from factloom.operators import retrieval as R

BASE = 1_700_000_000_000_000


def facts(spark, rows):
    """id, subject, object id, literal, seconds, superseded_by"""
    df = spark.createDataFrame(rows, "id string, subject_id string, object_id string, object_literal string, s double, superseded_by string")
    given = {"predicate": F.lit("likes"), "source_type": F.lit("whatsapp_text"), "first_seen": F.timestamp_micros(F.lit(BASE) + (F.col("s") * 1_000_000).cast("long")), "decay_locked": F.lit(False), "is_correction": F.lit(False), "source_message_ids": F.array().cast("array<string>")}
    return df.select(*[given.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.EDGES])


@pytest.mark.parametrize(("seed", "within"), [(1, 100), (2, 100), (3, 0)])
def test_links_lead_as_far_as_all_pairs(spark, seed, within):
    rng = random.Random(seed)
    texts = ["a b c d e f g", "b a c d e f g h", "a b c d e f", "A b, c d e f g", "x", "", " ? ", "x y", "a b c d e f g h i j k l", "a b c d e f g h i j k"]
    rows = []
    for i in range(220):
        entity = rng.random() < 0.3
        rows.append((f"{i:03d}", f"s{i % 3}", f"e{rng.randint(0, 2)}" if entity else None, None if entity else rng.choice(texts), float(rng.choice([0, 1, 40, 99, 100, 101, 250, 800, 801]) + 1000 * rng.randint(0, 3)), None))
    rows.append(("none", "s0", None, None, 0.0, None))
    e = facts(spark, rows)
    want = {(r.id, r.cluster) for r in dedup.clusters(dedup.duplicate_pairs(e, within)).collect()}
    got = {(r.id, r.cluster) for r in dedup.clusters(dedup.duplicate_links(e, within)).collect()}
    assert got == want and want


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_of_new_facts_give_the_clusters_of_a_full_pass(spark, seed):
    rng = random.Random(seed)
    texts = ["a b c d e f g", "b a c d e f g h", "a b c d e f", "x", "", "a b c d e f g h i j k l", "a b c d e f g h i j k"]
    rows = [(f"{i:03d}", f"s{i % 2}", f"e{rng.randint(0, 1)}" if i % 4 == 0 else None, rng.choice(texts) if i % 4 else None, float(rng.choice([0, 40, 99, 100, 101, 250, 800, 1801])), None) for i in range(90)]
    rng.shuffle(rows)
    e = facts(spark, rows)
    cuts = [0, *sorted(rng.sample(range(1, 90), 3)), 90]
    labels = dedup.clusters(dedup.duplicate_links(e.limit(0)))
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        old, new = (e.filter(F.col("id").isin(*[r[0] for r in part])) if part else e.limit(0) for part in (rows[:a], rows[a:z]))
        labels = dedup.dedup_new(labels, old, new, 100)
    want = {(r.id, r.cluster) for r in dedup.clusters(dedup.duplicate_links(e, 100)).collect()}
    assert {(r.id, r.cluster) for r in labels.collect()} == want and want


def test_a_busy_key_of_equal_facts_and_claims_takes_as_many_rows_as_it_has(spark):
    n = 20_000
    e = facts(spark, [("x", "s", None, "same words", 0.0, None)]).crossJoin(spark.range(n).withColumnRenamed("id", "k"))
    e = e.withColumns({"id": F.col("k").cast("string"), "superseded_by": F.when(F.col("k") > 0, "0")}).drop("k")
    assert dedup.duplicate_links(e.withColumn("superseded_by", F.lit(None).cast("string"))).count() == n - 1
    claims = e.select(F.col("id").alias("claim_id"), "subject_id", "predicate", "object_id", "object_literal", F.col("first_seen").alias("at"))
    messages = spark.createDataFrame([], "id string, timestamp timestamp")
    assert mutations.stale_claims(claims, e, messages, "2024-01-01 00:00:00").filter("stale").count() == 0
    dead = e.filter("superseded_by IS NOT NULL").unionByName(facts(spark, [("0", "t", None, "other", 9.0, None)]))
    assert mutations.stale_claims(claims, dead, messages, "2024-01-01 00:00:00").filter("stale").count() == n
    assert [r.id for r in R.matching_live(e, claims).collect()] == ["0"]


def test_objects_meet_by_entity_else_by_literal(spark):
    both = [(None, "x"), ("1", None), ("1", "x"), ("2", "x"), (None, None), (None, "X")]
    e = facts(spark, [(f"{k}", "s", i, t, 0.0, "gone") for k, (i, t) in enumerate(both)])
    wanted = spark.createDataFrame([("s", "likes", i, t, f"{k}") for k, (i, t) in enumerate(both)], "subject_id string, predicate string, object_id string, object_literal string, n string")
    w = wanted.select("subject_id", "predicate", F.col("object_id").alias("w_id"), F.col("object_literal").alias("w_lit"), "n")
    got = sorted((r.id, r.n) for r in R.meet_by_object(e, w).collect())
    want = sorted((f"{a}", f"{b}") for a, (i, t) in enumerate(both) for b, (j, u) in enumerate(both) if (i == j if i and j else t is not None and t == u))
    assert got == want
