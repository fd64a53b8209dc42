"""Scenarios over small tables: relationships, windows, ranking, changes, triples."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.functions import expr as X
from factloom.operators import analytics as A
from factloom.operators import dedup, mutations, reports, triples, windows
from factloom.operators import retrieval as R
from factloom.store import Store
from factloom.streaming.live_windows import LiveWindow

T0 = dt.datetime(2024, 2, 1)
AS_OF = "2024-02-15 00:00:00"
MESSAGE = "id long, conversation_id string, sender_id string, media_type string, raw_text string, transcript string, processed boolean, timestamp timestamp_ntz, external_id string"


def messages(spark, rows):
    """rows: conversation, sender, seconds after T0."""
    return spark.createDataFrame([(i, c, s, "text", "t", None, False, T0 + dt.timedelta(seconds=x), None) for i, (c, s, x) in enumerate(rows)], MESSAGE)


def volume(spark, counts):
    return messages(spark, [(c, s, 10 * i + k) for i, (c, s, n) in enumerate(counts) for k in range(n)])


def frequencies(spark, counts):
    m = volume(spark, counts)
    return {r.contact_id: r.frequency for r in A.frequency(m, A.classify_conversations(m, "me"), "me", AS_OF).collect()}


def test_frequency_of_direct_and_group_chats(spark):
    got = frequencies(spark, [("1", "me", 20), ("1", "a", 20), ("2", "me", 4), ("2", "b", 4)])
    assert got == pytest.approx({"a": 40 / 24, "b": 8 / 24})
    assert frequencies(spark, [("g", "me", 50), ("g", "a", 3), ("g", "b", 2)]) == pytest.approx({"a": 0.75 / 0.625, "b": 0.5 / 0.625})
    assert frequencies(spark, [("x", "me", 3)]) == {}


def test_conversation_kinds(spark):
    m = messages(spark, [("1", "me", 0), ("1", "a", 1), ("g", "a", 0), ("g", "b", 1), ("s", "me", 0)])
    assert {tuple(r) for r in A.classify_conversations(m, "me").collect()} == {("1", "one_to_one", "a"), ("g", "group", None)}


def replies(spark, rows):
    m = messages(spark, rows)
    return A.reply_latencies(m, A.classify_conversations(m, "me"), "me", AS_OF)


def test_reply_pairs(spark):
    got = replies(spark, [("1", "a", 0), ("1", "a", 30), ("1", "me", 90), ("1", "me", 100), ("1", "a", 200), ("1", "me", 260)])
    assert sorted(r.seconds for r in got.collect()) == [60, 60]
    assert A.reply_speed(got).first().reply_seconds == 60
    group = replies(spark, [("g", "a", 0), ("g", "b", 60), ("g", "me", 360), ("g", "a", 400), ("g", "me", 460), ("g", "b", 500), ("g", "me", 500 + 1801)])
    assert sorted((r.contact_id, r.seconds) for r in group.collect()) == [("a", 60), ("b", 300)]


def test_medians(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40)], "x double")
    assert df.select(A.exact_median(F.col("x")).alias("m")).first().m == 25 and A.upper_median(df, "x") == 30
    assert A.upper_median(df.limit(0), "x") is None
    assert df.limit(0).select(A.exact_median(F.col("x"))).first()[0] == -1


@pytest.mark.parametrize(("minutes", "sizes"), [([0, 1, 2, 3], [4]), ([0, 2, 6], [2, 1]), ([k / 60 for k in range(11)], [10, 1]), ([0, 5], [2]), ([], [])])
def test_live_windows_of_known_times(spark, minutes, sizes):
    got = windows.live_windows(messages(spark, [("c", "a", m * 60) for m in minutes])).groupBy("window_index").count().orderBy("window_index")
    assert [r["count"] for r in got.collect()] == sizes


def test_live_windows_equal_the_fold(spark):
    rng, rows = random.Random(3), []
    for c in "abc":
        at = 0
        for _ in range(120):
            at += rng.choice([1, 20, 100, 250, 301, 900])
            rows.append((c, "x", at))
    m = messages(spark, rows)
    want = {}
    for c in "abc":
        w, index = LiveWindow(), 0
        for i, (conv, _, at) in enumerate(rows):
            if conv == c:
                index += w.add(str(i), at * 1_000_000) is not None
                want[i] = index
    assert {r.id: r.window_index for r in windows.live_windows(m).collect()} == want


def test_recovery_makes_windows_of_ten_and_less(spark):
    got = windows.window_rows(windows.recovery_windows(messages(spark, [("a", "x", k) for k in range(12)] + [("b", "x", k) for k in range(2)]))).collect()
    assert sorted(len(r.ids) for r in got) == [2, 2, 10]


EDGE = S.EDGES


def edge(id_, lit="tea", subject="s", predicate="likes", day=0.0, sources=("m",), **kw):
    at = dt.datetime(2024, 2, 1) + dt.timedelta(days=day)
    base = dict(id=id_, subject_id=subject, predicate=predicate, object_id=None, object_literal=lit, confidence=0.8, importance=0.5, source_type="whatsapp_text", source_weight=1.0, source_message_ids=list(sources), first_seen=at, last_reinforced=at, decay_rate=S.STABLE, decay_locked=False, superseded_by=None, is_correction=False)
    return {**base, **kw}


def edges(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] for f in EDGE) for r in rows], EDGE)


def test_weights_turn_the_order_round(spark):
    e = edges(spark, edge("near", importance=0.1, sources=["1"]), edge("important", importance=0.9, sources=["2"]))
    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.6, 0.8])], "message_id string, vector array<float>")

    def top(w):
        return R.relevant_context(e, AS_OF, weights=w, embeddings=vectors, query=[1.0, 0.0]).first().id

    assert top(R.Weights(1, 0, 0)) == "near" and top(R.Weights(0.1, 0.1, 0.8)) == "important"
    assert R.Weights(0, 0, 0).effective() == R.Weights()
    assert R.pool_size(0) == (6, 30) and R.pool_size(99) == (50, 200)


def test_filters_none_and_empty_differ(spark):
    e = edges(spark, edge("a"), edge("b", source_type="user_deletion"), edge("c", superseded_by="a"), edge("d", source_type="voice_transcript", day=5))
    assert {r.id for r in e.filter(R.retrievable()).collect()} == {"a", "d"}
    assert e.filter(R.retrievable(R.Filters(source_types=()))).count() == 0
    assert {r.id for r in e.filter(R.retrievable(R.Filters(source_types=("voice_transcript",), since="2024-02-06 00:00:00", subject="s"))).collect()} == {"d"}


def test_merge_keeps_order_of_sources(spark):
    e = edges(spark, edge("1", sources=["a"]), edge("2", sources=["a", "b"], day=0.5), edge("3"), edge("4", decay_locked=True))
    members = spark.createDataFrame([("x", "1", 1), ("x", "2", 2), ("y", "3", 1), ("y", "4", 2)], "cluster string, id string, rank int")
    out, bad = mutations.merge_duplicates(e, members)
    got = {r.id: r for r in out.collect()}
    assert got["1"].source_message_ids == ["a", "b"] and got["1"].last_reinforced == dt.datetime(2024, 2, 1, 12) and got["2"].superseded_by == "1"
    assert got["3"].superseded_by is None and got["4"].superseded_by is None and [r.cluster for r in bad.collect()] == ["y"]


def test_dedup_chains_pairs(spark):
    chain = [edge(f"c{k}", "went to the gym today ok", day=0.9 * k) for k in range(4)]
    others = [edge("far", "went to the gym today ok", day=30), edge("else", "owns a boat"), edge("key", "went to the gym today ok", predicate="dislikes"), edge("lock", "went to the gym today ok", decay_locked=True)]
    e = edges(spark, *chain, *others)
    out, bad, merged = dedup.dedup_pass(e)
    assert merged.first().merged == 3 and bad.count() == 0
    assert {r.id: r.superseded_by for r in out.filter("superseded_by IS NOT NULL").collect()} == {"c1": "c0", "c2": "c0", "c3": "c0"}


def test_changes_and_their_conflicts(spark):
    e = edges(spark, edge("a", importance=0.7), edge("b", superseded_by="z"))
    ops = spark.createDataFrame([("a", 1, "n1"), ("a", 2, "n2"), ("b", 3, "n3"), ("q", 4, "n4")], "target string, seq int, new_id string")
    full = ops.selectExpr("*", "CAST(NULL AS STRING) AS subject_id", "'works_at' AS predicate", "CAST(NULL AS STRING) AS object_id", "'x' AS object_literal", "CAST(NULL AS DOUBLE) AS importance", "CAST(NULL AS TIMESTAMP) AS at")
    out, bad = mutations.correct(e, full, AS_OF)
    new = out.filter("id = 'n1'").first()
    assert (new.confidence, new.importance, new.decay_locked, new.is_correction, new.decay_rate, new.source_type) == (1.0, 0.7, True, True, S.SLOW, S.USER_CORRECTION)
    assert {r.target: r.reason for r in bad.filter("seq > 1").collect()} == {"a": "already_superseded", "b": "already_superseded", "q": "not_found"}
    gone, _ = mutations.soft_delete(e, ops, AS_OF)
    grave = gone.filter("id = 'n1'").first()
    assert (grave.object_literal, grave.confidence, grave.importance, grave.decay_locked, grave.source_message_ids) == ("tea", 0, 0, False, [])


def test_entities_are_made_once(spark):
    people = spark.createDataFrame([("1", "Ann", False), ("0", "Me", True)], "id string, canonical_name string, is_self boolean")
    wanted = spark.createDataFrame([("ANN", "person", 1), ("Bob", "topic", 2), ("bob", "person", 3)], "name string, type string, seq int")
    assert [tuple(r) for r in mutations.get_or_create(people, wanted).collect()] == [("Bob", "topic")]
    assert mutations.bootstrap_problems(people, "ann") == ["the self entity has another name", "another entity has this name: ann"]
    ids = spark.createDataFrame([("whatsapp", "12345678@s.whatsapp.net")], "platform string, identity string")
    senders = spark.createDataFrame([("whatsapp", "+1234 5678"), ("whatsapp", "Zoe")], "platform string, sender string")
    assert {r.sender: r.name for r in mutations.resolve_senders(senders, people, ids).collect()} == {"+1234 5678": "Me", "Zoe": "Zoe"}
    with pytest.raises(Exception, match="self entity"):
        mutations.resolve_senders(spark.createDataFrame([("whatsapp", "me")], "platform string, sender string"), people, ids).collect()


CLAIM = "claim_id string, window_seq int, triple_seq int, subject_id string, predicate string, object_id string, object_literal string, confidence double, is_correction boolean, replaces_object string, replaces_id string, source_type string, source_message_ids array<string>, correction_source_index int"


def claim(id_, lit, seq, correction=False, replaces=None, sources=("m1",), index=None):
    return (id_, seq, 0, "s", "likes", None, lit, 0.8, correction, replaces, None, "voice_transcript", list(sources), index)


def store(spark, facts, claims, extra=()):
    m = spark.createDataFrame([("m", T0), ("m1", T0 + dt.timedelta(days=1)), ("late", T0 + dt.timedelta(days=5)), *extra], "id string, timestamp timestamp")
    out, acts = triples.store_triples(edges(spark, *facts), spark.createDataFrame(claims, CLAIM), m, AS_OF)
    return {r.id: r for r in out.collect()}, {r.claim_id: r.action for r in acts.collect()}


def test_claims_see_those_before_them(spark):
    out, acts = store(spark, [], [claim("1", "tea", 1), claim("2", "tea", 2), claim("3", "milk", 3), claim("4", "juice", 4, True, "Milk")])
    assert acts == {"1": "created", "2": "reinforced", "3": "created", "4": "corrected"}
    assert sorted((r.object_literal, r.superseded_by is None, round(r.confidence, 3)) for r in out.values()) == [("juice", True, 1.0), ("milk", False, 0.76), ("tea", True, 0.76)]


def test_corrections_need_one_target(spark):
    two = [edge("a", "tea"), edge("b", "milk")]
    assert store(spark, two, [claim("1", "juice", 1, True)])[1] == {"1": "skipped_ambiguous_correction_target"}
    assert store(spark, two, [claim("1", "juice", 1, True, "wine")])[1] == {"1": "skipped_no_correction_target"}
    assert store(spark, [], [claim("1", "juice", 1, True)])[1] == {"1": "skipped_no_correction_target"}
    out, acts = store(spark, two, [claim("1", "juice", 1, True, " TEA ")])
    assert acts == {"1": "corrected"} and out["a"].superseded_by and out["b"].superseded_by is None
    assert store(spark, two, [claim("1", "milk", 1, True)])[1] == {"1": "reinforced"}


@pytest.mark.parametrize(("until", "action"), [(1, "skipped_stale"), (2, "skipped_stale"), (0.5, "created")])
def test_old_claims_do_not_bring_facts_back(spark, until, action):
    facts = [edge("a", "tea", superseded_by="b"), edge("b", "milk", day=until, sources=[], decay_locked=True, is_correction=True)]
    assert store(spark, facts, [claim("1", "tea", 1)])[1] == {"1": action}


def test_a_correction_has_the_time_of_its_message(spark):
    window = ("m", "m1", "late")  # days 0, 1 and 5
    out, acts = store(spark, [edge("a", "tea", day=2)], [claim("1", "juice", 1, True, sources=window, index=1)])
    (new,) = [r for r in out.values() if r.is_correction]
    assert acts == {"1": "corrected"} and new.first_seen == new.last_reinforced == T0 + dt.timedelta(days=1)
    out, acts = store(spark, [edge("a", "tea", day=2)], [claim("1", "tea", 1, True, sources=window, index=2)])
    assert acts == {"1": "reinforced"} and (out["a"].first_seen, out["a"].last_reinforced) == (T0 + dt.timedelta(days=2), T0 + dt.timedelta(days=5))
    out, _ = store(spark, [edge("a", "tea", day=2)], [claim("1", "tea", 1, sources=window)])
    assert (out["a"].first_seen, out["a"].last_reinforced) == (T0, T0 + dt.timedelta(days=5))


def test_names_become_entities(spark):
    people = spark.createDataFrame([("1", "Ann", False), ("0", "Zoe", True)], "id string, canonical_name string, is_self boolean")
    rows = [(1, 0, "ANN", "likes", "Tea", "entity"), (1, 1, " zoe d ", "pet_of", "Rex", "entity"), (2, 0, "rex", "likes", "tea", "entity"), (2, 1, "Bo", "likes", "sun", "literal")]
    got, new = triples.resolve_names(spark.createDataFrame(rows, "window_seq int, triple_seq int, subject string, predicate string, object string, object_type string"), people, ("Zoe", "Zoe D"))
    made = {r.canonical_name: r for r in new.collect()}
    assert {n: r.type for n, r in made.items()} == {"Tea": "object", "Rex": "person", "Bo": "person"}
    ids = {(r.window_seq, r.triple_seq): (r.subject_id, r.object_id, r.object_literal) for r in got.collect()}
    assert ids == {(1, 0): ("1", made["Tea"].id, None), (1, 1): ("0", made["Rex"].id, None), (2, 0): (made["Rex"].id, made["Tea"].id, None), (2, 1): (made["Bo"].id, None, "sun")}


def plain_runs(times, idle, longest, start, end):
    """The trigger's rule, a second at a time."""
    activity = run = start
    done, out = False, []
    for now in range(start, end + 1):
        if now - activity >= idle and not done:
            out.append((now, "idle_threshold"))
            run, done = now, True
        elif now - run >= longest and now < end:
            out.append((now, "max_interval_fallback"))
            run, done = now, True
        if now in times:
            activity, done = now, False
    return out


@pytest.mark.parametrize("seed", range(6))
def test_idle_runs_equal_the_rule_second_by_second(spark, seed):
    rng, at, times = random.Random(seed), 0, [0]
    for _ in range(rng.choice([5, 60])):
        at += rng.choice([3, 17, 59, 61, 200] if seed % 2 else [7, 11])
        times.append(at)
    m = messages(spark, [(f"c{k % 3}", "a", t) for k, t in enumerate(times)])
    base = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    for start, end in [(0, at + rng.choice([10, 500])), (rng.randint(0, at), at + 300), (rng.randint(0, at // 2), rng.randint(at // 2, at)), (at + 50, at + 400)]:
        got = A.idle_points(m, 60, 97, until=str(T0 + dt.timedelta(seconds=end)), start=str(T0 + dt.timedelta(seconds=start)) if start else None)
        within = {t for t in times if start <= t <= end}
        assert sorted((r.at - base, r.reason) for r in got.collect()) == plain_runs(within, 60, 97, start, end), (start, end)


def test_idle_runs_without_messages(spark):
    m = messages(spark, [("c", "a", 0)]).limit(0)
    assert A.idle_points(m).count() == A.idle_points(m, until=AS_OF).count() == 0
    got = A.idle_points(m, 60, 1000, start="2024-01-01 00:00:00", until="2024-01-01 00:20:00").collect()
    assert [(r.reason, r.at % 86400) for r in got] == [("idle_threshold", 60), ("max_interval_fallback", 1060)]


def test_a_busy_series_has_fallback_runs(spark):
    m = messages(spark, [("c", "a", 600 * k) for k in range(6 * 24 * 3)])  # three days, a message every ten minutes
    got = A.idle_points(m).collect()
    assert [r.reason for r in got] == ["max_interval_fallback"] * 3


def test_self_entity_is_made_once(spark):
    none = spark.createDataFrame([("1", "person", "Ann", False, None, None, None)], S.ENTITIES)
    made = mutations.bootstrap_self(none, "Zoe", ("+49 30 1",), AS_OF)
    assert [(r.canonical_name, r.type) for r in made.filter("is_self").collect()] == [("Zoe", "person")]
    assert mutations.bootstrap_self(made, "ZOE", (), AS_OF).count() == 2
    with pytest.raises(ValueError, match="another name.*another entity has this name: ann"):
        mutations.bootstrap_self(made, "Zo", ("Ann",), AS_OF)


def test_recovery_counts_messages_of_unknown_senders(spark):
    m = messages(spark, [("c", "a", 0), ("c", "gone", 1), ("c", "a", 2)])
    people = spark.createDataFrame([("a", "Ann")], "id string, canonical_name string")
    assert {r.id for r in windows.recovery_windows(m, people).collect()} == {0, 2}
    assert windows.recovery_errors(m, people).first().asDict() == {"errors": 1, "recovered": 2}


@pytest.mark.parametrize("n", [3000, 12000])
def test_one_busy_conversation_streams_through_its_window_rule(spark, n):
    got = windows.live_windows(messages(spark, [("c", "a", 20 * k) for k in range(n)])).groupBy("window_index").count()
    assert {r["count"] for r in got.collect()} == {10} and got.count() == n // 10


def test_only_own_messages_correct(spark):
    m = spark.createDataFrame([("m1", "me"), ("m2", "a")], "id string, sender_id string")
    people = spark.createDataFrame([("me", True), ("a", False)], "id string, is_self boolean")
    rows = [(k, i, ["m1", "m2", "gone"], True) for k, i in enumerate([0, 1, 2, 3, -1, None])]
    got = triples.trusted_corrections(spark.createDataFrame(rows, "k int, correction_source_index int, window_ids array<string>, is_correction boolean"), m, people)
    assert {r.k for r in got.collect() if r.is_correction} == {0}
    assert got.count() == 6


def test_model_output(spark):
    rows = [(1, '```json\n[{"subject":"a","predicate":"likes","object":"b","object_type":"literal","confidence":1.0}]\n```'), (2, "sorry"), (3, "[]"), (4, None)]
    got = triples.parse_output(spark.createDataFrame(rows, "window_id int, output string"))
    assert {(r.window_id, r.subject, r.parse_error is not None) for r in got.collect()} == {(1, "a", False), (2, None, True), (4, None, True)}


def test_reports(spark):
    df = spark.createDataFrame([(i, f"f{i % 3}", float(i)) for i in range(30)], "id int, file string, confidence double")
    sample = reports.stratified_sample(df, "file", 7, 1)
    assert sample.count() == 7 and {r.file for r in sample.collect()} == {"f0", "f1", "f2"}
    uneven = spark.createDataFrame([(i, "a" if i else "b") for i in range(101)], "id int, file string")
    assert reports.stratified_sample(uneven, "file", 10, 1).count() == 6
    assert reports.stratified_sample(df, "file", 99, 1).count() == 30
    assert reports.distribution(df).first().median == 15
    kinds = spark.createDataFrame([(i, f"k{i % 40}") for i in range(80)], "id int, event_type string")
    assert reports.event_counts(kinds).filter("event_type = '(other)'").first().n == 16


def test_trial_run_report(spark, tmp_path):
    w = spark.createDataFrame([(1, True), (2, True), (3, False)], "window_id int, is_candidate boolean")
    o = spark.createDataFrame([(1, "created"), (1, "corrected")], "window_id int, action string")
    t = spark.createDataFrame([(1, 0.5), (2, 0.9)], "id int, confidence double")
    bad = spark.createDataFrame([("unknown_predicate",)], "reject_reason string")
    usage = spark.createDataFrame([("m", "chat", 1, 2, 3, 0.0, False, "x", T0)], "model string, path string, prompt_tokens long, completion_tokens long, total_tokens long, estimated_cost_usd double, price_found boolean, agent string, timestamp_utc timestamp")
    usage.write.parquet(f"{tmp_path}/usage")
    read = reports.read_usage(spark, f"{tmp_path}/usage", "x", "2024-01-31", "2024-02-02")
    got = reports.dry_run_report(w, o, t, bad, read, 2)
    assert got["windows"]["candidates"] == 2 and got["actions"]["created"] == 1 and got["zero_yield_windows"] == 1 and got["rejected"] == {"unknown_predicate": 1}
    assert reports.read_usage(spark, f"{tmp_path}/usage", "x", "2024-02-02").count() == 0
    assert '"zero_yield_windows": 1' in reports.as_json(got) and "| m | chat | 1 | 1 | 2 | 3 | not measured | 0 |" in reports.as_markdown(got)
    reports.write_report(reports.as_markdown(got), f"{tmp_path}/r.md")
    assert (tmp_path / "r.md").stat().st_mode & 0o777 == 0o600


def test_snapshots(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.versions() == []
    s.commit(a=spark.range(3), b=spark.range(1))
    s.commit(a=s.read("a").union(spark.range(1)))
    assert (s.read("a").count(), s.read("a", 1).count(), s.read("b").count(), s.versions()) == (4, 3, 1, [1, 2])
    with pytest.raises(LookupError):
        s.read("c")


def test_a_summary_is_of_people_only(spark):
    people = spark.createDataFrame([("1", "person", "Ann"), ("2", "place", "Rome")], "id string, type string, canonical_name string")
    none, stats = spark.createDataFrame([], S.EDGES), spark.createDataFrame([], S.RELATIONSHIP_STATS)
    assert [r.canonical_name for r in R.contact_summary(people, none, stats, "1", AS_OF).collect()] == ["Ann"]
    assert R.contact_summary(people, none, stats, "3", AS_OF).count() == 0
    with pytest.raises(Exception, match="not a person"):
        R.contact_summary(people, none, stats, "2", AS_OF).collect()
    with pytest.raises(NotImplementedError):
        R.style_profile("1")


def test_a_prompt_holds_vocabulary_and_messages(spark):
    rows = spark.createDataFrame([(0, "Ann", 'say "hi"\n{messages}'), (1, None, "x")], "i int, who string, text string").withColumn("ts", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    line = X.prompt_line(F.col("i"), F.col("ts"), F.col("who"), F.col("text"))
    got = rows.orderBy("i").agg(X.prompt("Only {vocabulary}.\n{messages}\nEnd", F.collect_list(line)).alias("p")).first().p
    head, *lines, end = got.split("\n")
    assert head == f"Only {', '.join(S.PREDICATES)}." and end == "End"
    assert [json.loads(x) for x in lines] == [{"i": 0, "ts": "2024-01-02 03:04:05", "speaker": "Ann", "text": 'say "hi"\n{messages}'}, {"i": 1, "ts": "2024-01-02 03:04:05", "text": "x"}]
