from __future__ import annotations

import math
import uuid

import pytest
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.functions import expr as X
from factloom.operators import retrieval as R

AS_OF = "2024-03-01 00:00:00"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


def fact(confidence=0.9, importance=0.5, rate=0.01, days=30, locked=False, correction=False):
    import datetime as dt

    at = dt.datetime(2024, 3, 1) - dt.timedelta(days=days)
    return {"confidence": ("double", confidence), "importance": ("double", importance), "decay_rate": ("double", rate), "last_reinforced": ("timestamp_ntz", at), "decay_locked": ("boolean", locked), "is_correction": ("boolean", correction)}


def test_confidence_decays_by_fractional_days(spark):
    assert one(spark, X.effective_confidence(AS_OF), **fact()) == pytest.approx(0.9 * math.exp(-0.3), abs=1e-9)
    assert one(spark, X.effective_confidence(AS_OF), **fact(days=-5)) == 0.9
    assert one(spark, X.effective_confidence(AS_OF), **fact(days=18_000, locked=True)) == 0.9


@pytest.mark.parametrize(("confidence", "importance", "gone"), [(0.15, 0.1, False), (0.05, 0.5, True), (0.9, 0.05, True), (0.149, 0.1, True)])
def test_facts_at_a_floor_stay(spark, confidence, importance, gone):
    assert one(spark, R.prunable(AS_OF), **fact(confidence, importance, rate=0.0)) is gone
    assert one(spark, R.prunable(AS_OF), **fact(confidence, importance, rate=0.0, locked=True)) is False
    assert one(spark, R.prunable(AS_OF), **fact(confidence, importance, rate=0.0, correction=True)) is False


@pytest.mark.parametrize(("a", "b", "low", "high"), [("went to the gym", "Went to the gym today", 8 / 9, 8 / 9), ("likes tea", "owns a boat", 0, 0.3), ("Hello, World!", "hello world", 1, 1), ("", "", 1, 1), ("", "x", 0, 0)])
def test_word_overlap(spark, a, b, low, high):
    got = one(spark, X.dice(X.tokens(F.col("a")), X.tokens(F.col("b"))), a=("string", a), b=("string", b))
    assert low - 1e-9 <= got <= high + 1e-9


def test_closeness_of_known_values(spark):
    us = int(__import__("datetime").datetime(2024, 3, 1, tzinfo=__import__("datetime").timezone.utc).timestamp() * 1e6)
    values = {"f": ("double", 1.0), "s": ("double", 1800.0), "l": ("long", us), "n": ("long", 5)}
    assert one(spark, X.closeness(F.col("f"), F.col("s"), F.col("l"), F.col("n"), AS_OF), **values) == pytest.approx(0.525)
    none = {"f": ("double", 0.0), "s": ("double", -1.0), "l": ("long", None), "n": ("long", 0)}
    assert one(spark, X.closeness(F.col("f"), F.col("s"), F.col("l"), F.col("n"), AS_OF), **none) == 0


def test_uuid5_is_pythons(spark):
    for name in ("whatsapp:1", "instagram:ünï", ""):
        assert one(spark, X.uuid5(F.col("n")), n=("string", name)) == str(uuid.uuid5(X.NAMESPACE, name))


def test_rates_and_weights(spark):
    assert one(spark, X.default_decay_rate(F.lit("likes"))) == S.STABLE
    assert one(spark, X.default_decay_rate(F.lit("never heard of"))) == S.SLOW
    assert one(spark, X.weighted_confidence(F.lit(0.5), F.lit("instagram_story"))) == pytest.approx(0.1)
    with pytest.raises(Exception, match="unknown source type"):
        one(spark, X.weighted_confidence(F.col("c"), F.col("s")), c=("double", 0.5), s=("string", "fax"))
    assert one(spark, X.reconstructed_confidence(F.lit(0.5), F.lit(0.0))) == 0
    assert one(spark, X.cosine(F.array(F.lit(0.6), F.lit(0.8)), F.array(F.lit(0.6), F.lit(0.8)))) == pytest.approx(1)
    assert one(spark, X.cosine(F.array(F.lit(0.0)), F.array(F.lit(0.0)))) is None


def test_text_helpers(spark):
    assert one(spark, X.repair_mojibake(F.col("s")), s=("string", "cafÃ©")) == "café"
    assert one(spark, X.repair_mojibake(F.col("s")), s=("string", "café")) == "café"
    assert one(spark, X.repair_mojibake(F.col("s")), s=("string", "日本")) == "日本"
    assert one(spark, X.strip_fence(F.col("s")), s=("string", " ```json\n[1]\n``` ")) == "[1]"
    assert one(spark, X.strip_fence(F.col("s")), s=("string", "[1]")) == "[1]"
    assert one(spark, X.event_tense(F.lit("event_future"), F.lit("2024-02-29").cast("timestamp_ntz"), AS_OF)) == "event_past"
    assert one(spark, X.event_tense(F.lit("event_future"), F.lit(AS_OF).cast("timestamp_ntz"), AS_OF)) == "event_future"
    assert one(spark, X.window_source_type(F.array(F.lit("text"), F.lit("voice")))) == "voice_transcript"
    with pytest.raises(Exception, match="no text"):
        one(spark, X.window_source_type(F.array(F.col("m"))), m=("string", "image"))
    assert one(spark, R.contains(F.lit("50% off_now"), "0% OFF_")) is True
    assert one(spark, R.contains(F.lit("abc"), "a_c")) is False
    assert one(spark, X.same_object(F.lit(None).cast("int"), F.lit("Tea"), F.lit(None).cast("int"), F.lit("tea"))) is False
    assert one(spark, X.keep_last_four(F.lit("123456789"))) == "\u20266789"
    assert one(spark, X.cut_digits(F.lit("from 4676123456:1 port 8080"))) == "from \u20263456:1 port 8080"


@pytest.mark.parametrize(("raw", "want"), [("+961 70-123 456", "96170123456@s.whatsapp.net"), ("96170123456:3@c.us", "96170123456@s.whatsapp.net"), ("123@lid", "123@lid"), ("123@g.us", None), ("12345", None), ("Al", None), (" Alice ", "Alice")])
def test_identities(spark, raw, want):
    assert one(spark, X.normalise_identity(F.col("s")), s=("string", raw)) == want


def test_rows_that_break_rules(spark):
    rows = [("a", "x", None, ["m"]), ("b", None, None, ["m"]), ("c", "x", "y", None)]
    df = spark.createDataFrame(rows, "id string, object_id string, object_literal string, source_message_ids array<string>")
    assert {tuple(r) for r in S.edge_violations(df).collect()} == {("b", "object_xor"), ("c", "object_xor"), ("c", "sources_set")}
    people = spark.createDataFrame([("a", "person", True), ("b", "robot", True)], "id string, type string, is_self boolean")
    assert {tuple(r) for r in S.entity_violations(people).collect()} == {("b", "type"), ("a", "one_self"), ("b", "one_self")}
    assert S.dangling(df, "object_id", spark.createDataFrame([("x",)], "id string")).count() == 0
    with pytest.raises(ValueError, match="missing"):
        S.expect(df, S.EDGES)
