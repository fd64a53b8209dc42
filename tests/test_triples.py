from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.functions.identity import Registry
from factloom.operators import triples

AS_OF = "2024-03-01 00:00:00"
DAY = 1_709_000_000_000_000


def sequences(seed):
    """Facts, claims and messages with ties, repeats, stated old values of all kinds and times in no order."""
    rng = random.Random(seed)
    messages = [(f"m{i}", DAY + rng.randint(0, 40) * 1_000_000) for i in range(40)]
    values = [("e1", None), ("e2", None), (None, "v1"), (None, "V1"), (None, " v2 "), (None, "v3")]
    edges, claims = [], []
    for k in range(9):
        key = (f"s{k}", rng.choice(["likes", "works_at"]))
        own = [f"{k}.{i}" for i in range(rng.randint(0, 5))]
        for i in own:
            obj, lit = rng.choice(values)
            by = rng.choice([None, None, rng.choice(own)])
            edges.append((i, *key, obj, lit, 0.5, rng.random(), rng.choice(["whatsapp_text", "whatsapp_text", S.USER_DELETION]), 1.0, rng.sample([m for m, _ in messages], 2) if rng.random() < 0.7 else [], DAY + rng.randint(0, 9) * 1_000_000, DAY + rng.randint(9, 40) * 1_000_000, 0.1, False, by, False))
        for n in range(rng.randint(1, 11)):
            obj, lit = rng.choice(values)
            sources = rng.sample([m for m, _ in messages], rng.randint(0, 3))
            claims.append((f"c{k}.{n}", n // 3, n % 3, *key, obj, lit, rng.random(), rng.random() < (0.18 if k % 3 else 0.0), rng.choice([None, None, " ", "V1 ", "e2 name", "nothing"]), None, rng.choice(["whatsapp_text", "voice_transcript"]), sources, rng.choice([None, 0, 1, 7])))
    claims = [(*c[:10], "e2" if c[9] == "e2 name" else None, *c[11:]) for c in claims]
    return edges, claims, messages


CLAIM = "claim_id string, window_seq long, triple_seq int, subject_id string, predicate string, object_id string, object_literal string, confidence double, is_correction boolean, replaces_object string, replaces_id string, source_type string, source_message_ids array<string>, correction_source_index int"


def tables(spark, edges, claims, messages):
    e = spark.createDataFrame(edges, "id string, subject_id string, predicate string, object_id string, object_literal string, confidence double, importance double, source_type string, source_weight double, source_message_ids array<string>, a long, b long, decay_rate double, decay_locked boolean, superseded_by string, is_correction boolean")
    e = e.select(*[F.timestamp_micros({"first_seen": "a", "last_reinforced": "b"}[f.name]).alias(f.name) if f.name in ("first_seen", "last_reinforced") else F.col(f.name) for f in S.EDGES])
    return e, spark.createDataFrame(claims, CLAIM).repartition(3), spark.createDataFrame(messages, "id string, us long").select("id", F.timestamp_micros("us").alias("timestamp"))


def by_hand(edges, claims, messages):
    time, out, actions = dict(messages), {}, {}
    now = 1_709_251_200_000_000
    facts = {e[0]: e for e in edges}
    for key in {(c[3], c[4]) for c in claims}:
        held = []
        for e in edges:
            if (e[1], e[2]) == key:
                by = facts.get(e[14])
                until = None if by is None else max([min(time[m], now) for m in by[9]], default=min(by[10], now))
                held.append({"id": e[0], "subject_id": e[1], "predicate": e[2], "object_id": e[3], "object_literal": e[4], "confidence": e[5], "importance": e[6], "source_type": e[7], "source_weight": 1.0, "source_message_ids": e[9], "first_us": e[10], "last_us": e[11], "decay_locked": False, "superseded_by": e[14], "is_correction": False, "until": until})
        asked = []
        for c in claims:
            if (c[3], c[4]) == key:
                seen = [time[m] for m in c[12]]
                first, last = min(seen, default=now), max(seen, default=now)
                at = time[c[12][c[13]]] if c[13] is not None and c[13] < len(c[12]) else first
                asked.append(dict(zip([x.split()[0] for x in CLAIM.split(", ")], c, strict=True)) | {"first_us": first, "last_us": last, "at_us": at})
        for r in triples.fold_key(held, asked):
            if r["kind"] == "edge":
                out[r["id"]] = r
            else:
                actions[r["claim_id"]] = r["action"]
    return out, actions


@pytest.mark.parametrize(("seed", "unit"), [(1, 0), (2, 20_000), (3, 8)])
def test_rounds_by_object_equal_the_sequence(spark, seed, unit):
    edges, claims, messages = sequences(seed)
    out, actions = triples.store_triples(*tables(spark, edges, claims, messages), AS_OF, unit=unit)
    want, want_actions = by_hand(edges, claims, messages)
    assert dict(map(tuple, actions.select("claim_id", "action").collect())) == want_actions
    columns = ["subject_id", "predicate", "object_id", "object_literal", "confidence", "importance", "source_type", "source_weight", "decay_locked", "superseded_by", "is_correction"]
    got = {r.id: r for r in out.withColumns({"a": F.unix_micros("first_seen"), "b": F.unix_micros("last_reinforced")}).collect()}
    assert set(got) == set(want) | {e[0] for e in edges}
    for i, w in want.items():
        assert [round(x, 12) if isinstance(x, float) else x for x in [got[i][c] for c in columns]] == [round(x, 12) if isinstance(x, float) else x for x in [w[c] for c in columns]], i
        assert (got[i].a, got[i].b, sorted(got[i].source_message_ids)) == (w["first_us"], w["last_us"], sorted(w["source_message_ids"]))


def test_one_key_with_very_many_claims_lies_in_many_tasks(spark):
    claims = spark.range(60_000).select(F.concat(F.lit("c"), "id").alias("claim_id"), F.col("id").alias("window_seq"), F.lit(0).alias("triple_seq"), F.lit("s").alias("subject_id"), F.lit("likes").alias("predicate"), F.lit(None).cast("string").alias("object_id"), F.concat(F.lit("v"), F.col("id") % 5000).alias("object_literal"), F.lit(0.5).alias("confidence"), F.col("id").isin(20_000, 40_000).alias("is_correction"), F.when(F.col("id") == 20_000, "v7").alias("replaces_object"), F.lit(None).cast("string").alias("replaces_id"), F.lit("whatsapp_text").alias("source_type"), F.array().cast("array<string>").alias("source_message_ids"))
    edges = spark.createDataFrame([], S.EDGES)
    messages = spark.createDataFrame([], "id string, timestamp timestamp")
    out, actions = triples.store_triples(edges, claims.withColumn("object_literal", F.when(F.col("window_seq") == 20_000, "fresh").otherwise(F.col("object_literal"))), messages, AS_OF, unit=1000)
    got = {r.action: r.n for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
    # v7 is corrected away; all later claims of it were said no later; the second correction restates a live value
    assert got == {"created": 5000, "corrected": 1, "reinforced": 60_000 - 5000 - 1 - 8, "skipped_stale": 8}
    assert out.filter("superseded_by IS NULL").count() == 5000


def windows(spark, rows):
    return spark.createDataFrame([(n, ids, kind, json.dumps(out) if isinstance(out, list) else out) for n, ids, kind, out in rows], "window_seq long, window_ids array<string>, source_type string, output string")


def said(subject, predicate, obj, **more):
    return {"subject": subject, "predicate": predicate, "object": obj, "object_type": "literal", "confidence": 0.5, "is_correction": False} | more


def test_from_model_output_to_facts_with_all_actions(spark):
    people = spark.createDataFrame([("me", "person", "Renée", True), ("kim", "person", "Kim", False), ("acme", "object", "Acme", False)], "id string, type string, canonical_name string, is_self boolean")
    messages = spark.createDataFrame([("m1", "me", "2024-01-01"), ("m2", "kim", "2024-01-02"), ("m3", "me", "2024-01-03"), ("m4", "me", "2024-01-04")], "id string, sender_id string, t string").withColumn("timestamp", F.to_timestamp("t")).drop("t")
    fix = {"is_correction": True, "correction_source_index": 0}
    rows = [
        (1, ["m1"], "whatsapp_text", [said("Kim", "likes", "tea"), said("kim", "works_at", "Acme", object_type="entity"), said("Renée", "likes", "tea"), said("Kim", "feels", "x"), said(" ", "likes", "x")]),
        (2, ["m3"], "whatsapp_text", [said("Kim", "works_at", "Beta", object_type="entity", replaces_object=" ACME ", **fix), said("Kim", "likes", "rum", replaces_object="  ", **fix), said("Kim", "dislikes", "rum", **fix)]),
        (3, ["m2"], "whatsapp_text", [said("Kim", "likes", "tea"), said("Kim", "likes", "milk", **fix), said("Kim", "likes", "rum")]),
        (4, ["m4"], "voice_transcript", [said("Kim", "likes", "gin", **fix), said("Kim", "works_at", "Gamma", object_type="entity", replaces_object="Nobody Known", **fix), said("Kim", "likes", "tea")]),
        (5, ["m4"], "whatsapp_text", "no list"),
    ]
    me = Registry("Renée")
    for unit in (0, 20_000):
        got = triples.store_extracted(windows(spark, rows), spark.createDataFrame([], S.EDGES), people, messages, me, AS_OF, unit=unit)
        actions = {(r.window_seq, r.triple_seq): r.action for r in got["outcomes"].collect()}
        assert actions == {
            (1, 0): "created", (1, 1): "created", (1, 2): "created",
            (2, 0): "corrected", (2, 1): "corrected", (2, 2): "skipped_no_correction_target",
            (3, 0): "skipped_stale", (3, 1): "created", (3, 2): "reinforced",
            (4, 0): "skipped_ambiguous_correction_target", (4, 1): "skipped_no_correction_target", (4, 2): "created",
        }
        assert {(r.window_seq, r.triple_seq, r.reason) for r in got["refused"].collect()} == {(1, 3, "unknown_predicate"), (1, 4, "empty_subject"), (5, None, "parse_error")}
        named = {r.canonical_name: r.id for r in got["entities"].collect()}
        assert set(named) == {"Renée", "Kim", "Acme", "Beta", "Gamma"} and len(named) == got["entities"].count()
        live = {(r.subject_id, r.predicate, r.object_id or r.object_literal) for r in got["edges"].filter("superseded_by IS NULL").collect()}
        assert live == {("kim", "likes", "rum"), ("kim", "likes", "milk"), ("kim", "likes", "tea"), ("kim", "works_at", named["Beta"]), ("me", "likes", "tea")}
        assert got["edges"].count() == 7


def test_a_bulk_import_makes_ordinary_claims_of_corrections(spark):
    people = spark.createDataFrame([("me", "person", "Me", True)], "id string, type string, canonical_name string, is_self boolean")
    messages = spark.createDataFrame([("m1", "me")], "id string, sender_id string").withColumn("timestamp", F.to_timestamp(F.lit("2024-01-01")))
    rows = [(1, ["m1"], "whatsapp_text", [said("Me", "likes", "a"), said("Me", "likes", "b", is_correction=True, correction_source_index=0)])]
    got = triples.store_extracted(windows(spark, rows), spark.createDataFrame([], S.EDGES), people, messages, ("Me",), AS_OF, corrections=False)
    assert [r.action for r in got["outcomes"].collect()] == ["created", "created"]
    nothing = triples.store_extracted(windows(spark, rows).limit(0), got["edges"], people, messages, ("Me",), AS_OF)
    assert nothing["edges"].count() == 2 and nothing["outcomes"].count() == nothing["refused"].count() == 0


def test_a_key_with_very_many_corrections_takes_no_round_for_each(spark):
    # each correction replaces the value before it, and a value comes back after nine others; what was said no later is stale
    n = F.col("id")
    value = F.when(n % 3 == 2, F.greatest(F.floor(n / 3) - 1, F.lit(0))).otherwise(F.floor(n / 3)) % 10
    claims = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("claim_id"), n.alias("window_seq"), F.lit(0).alias("triple_seq"), F.lit("s").alias("subject_id"), F.lit("likes").alias("predicate"), F.lit(None).cast("string").alias("object_id"), F.concat(F.lit("v"), value).alias("object_literal"), F.lit(0.5).alias("confidence"), (n % 3 == 0).alias("is_correction"), F.lit(None).cast("string").alias("replaces_object"), F.lit(None).cast("string").alias("replaces_id"), F.lit("whatsapp_text").alias("source_type"), F.array(F.concat(F.lit("m"), F.when(n % 3 == 2, n - 2).otherwise(n).cast("string"))).alias("source_message_ids"))
    messages = spark.range(3000).select(F.concat(F.lit("m"), "id").alias("id"), F.timestamp_micros(n + DAY - 86_400_000_000).alias("timestamp"))
    before = spark._jsc.sc().dagScheduler().nextJobId()
    out, actions = triples.store_triples(spark.createDataFrame([], S.EDGES), claims, messages, AS_OF, unit=100)
    got = {r.action: r.n for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
    assert got == {"skipped_no_correction_target": 1, "created": 1, "corrected": 999, "reinforced": 1000, "skipped_stale": 999}
    assert out.filter("superseded_by IS NULL").count() == 1
    assert spark._jsc.sc().dagScheduler().nextJobId() - before < 100


@pytest.mark.parametrize("few", [True, False])
def test_few_names_are_sent_to_the_triples(spark, monkeypatch, few):
    monkeypatch.setattr(triples, "FEW_NAMES", 100_000 if few else 0)
    rows = [(i, 0, f"Per {i % 3}", "likes", f"Thing {i % 2}", "entity", " per 1 " if i == 5 else None) for i in range(40)]
    people = spark.createDataFrame([(-1, "person", "Self", True), (7, "person", "PER 1", False)], "id long, type string, canonical_name string, is_self boolean")
    given = spark.createDataFrame(rows, "window_seq int, triple_seq int, subject string, predicate string, object string, object_type string, replaces_object string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, new = triples.resolve_names(given, people, ("Per 2",))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" not in plan) == few  # else all triples are shuffled for each kind of name
        assert sorted((r.type, r.canonical_name) for r in new.collect()) == [("object", "Thing 0"), ("object", "Thing 1"), ("person", "Per 0")]
        found = {r.window_seq: r for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found[1].subject_id == "7" and found[2].subject_id == "-1" and found[5].replaces_id == "7" and found[4].replaces_id is None
    assert len(found) == 40 and found[0].object_id == found[2].object_id != found[1].object_id
