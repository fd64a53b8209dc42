from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import models as M
from factloom.sources import exports, live

#: A market stall's chat: both clock styles, a forged header, attachments with and without a caption, notices.
EXPORT = """17/3/23, 6:58 AM - Cheese stall created group "Saturday"
17/3/23, 6:59 AM - Marta: van is loaded
17/3/23, 6:59 AM - Marta: van is loaded
17/3/23, 7:30 AM - Old Tom: notes.pdf (file attached)
17/3/23, 7:31 AM - Old Tom: stall_plan.PNG (file attached)
17/3/23, 12:05 PM - Marta: prices today:
brie 4
gouda 3
16/3/23, 11:00 PM - Old Tom: free cheese for all
17/3/23, 12:04 PM - Old Tom: within a minute, so it is real
[17/03/2023, 14:20:31] Marta: ‎video omitted
[17/03/2023, 14:21:02] Old Tom: order.opus (file attached)
for the baker
[17/03/2023, 14:22:00] Marta: contact card omitted
[17/03/2023, 14:22:05] Marta: a/b.mp3 (file attached)
[17/03/2023, 14:23:00] The baker left
this line belongs to nobody
[17/03/2023, 14:24:00] Old Tom: sold out: home now
"""


def test_text_export(spark):
    files = spark.createDataFrame([("stall", EXPORT), ("blank", ""), ("none", None)], "conversation_id string, value string")
    got = exports.parse_text_exports(files).orderBy("position").collect()
    assert [(r.sender_external_id, r.media_type, r.text, r.media_url, r.timestamp.strftime("%H:%M:%S")) for r in got] == [
        ("Marta", "text", "van is loaded", None, "06:59:00"),
        ("Marta", "text", "van is loaded", None, "06:59:00"),
        ("Old Tom", "image", None, "stall_plan.PNG", "07:31:00"),
        ("Marta", "text", "prices today:\nbrie 4\ngouda 3\n16/3/23, 11:00 PM - Old Tom: free cheese for all", None, "12:05:00"),
        ("Old Tom", "text", "within a minute, so it is real", None, "12:04:00"),
        ("Marta", "video", None, None, "14:20:31"),
        ("Old Tom", "voice", "for the baker", "order.opus", "14:21:02"),
        ("Old Tom", "text", "sold out: home now", None, "14:24:00"),
    ]
    assert len({r.external_id for r in got}) == 8 and {r.conversation_id for r in got} == {"stall"}
    winter = exports.parse_text_exports(files, "America/New_York").orderBy("position").first()
    assert winter.timestamp == dt.datetime(2023, 3, 17, 10, 59)


def test_stamps_roll_over():
    assert exports.parse_stamp("7/15/19", "00:07") == dt.datetime(2020, 3, 7, 0, 7)
    assert exports.parse_stamp("29/2/2023", "12:30 PM") == dt.datetime(2023, 3, 1, 12, 30)
    assert exports.parse_stamp("2/9/08", "12:01:59 am") == dt.datetime(2008, 9, 2, 0, 1, 59)
    assert exports.parse_stamp("2/9/08", "13:00 pm") is None and exports.parse_stamp("2/9/08", "7:60") is None


def test_folders_of_exports(spark, tmp_path):
    (tmp_path / "stall.txt").write_text(EXPORT)
    (tmp_path / "stall.csv").write_text(EXPORT)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "other.txt").write_text(EXPORT)
    assert {r.conversation_id for r in exports.read_text_exports(spark, str(tmp_path)).collect()} == {"stall"}


def moment(k, sender, **kw):
    return {"sender_name": sender, "timestamp_ms": 1_660_000_000_000 + 7_919 * k, **kw}


def test_json_threads(spark, tmp_path):
    twice = {"sender_name": "Kai", "timestamp_ms": 1_659_999_000_123, "content": "again"}
    moments = [
        moment(1, "JosÃ©", is_unsent=True, content="never mind"),
        moment(2, "Kai", audio_files=[{"uri": "hum.aac"}], content="listen"),
        moment(3, "JosÃ©", content="lÃ¤uft â\u0080\u0093 gut"),
        moment(4, "Kai", content="Reacted ❤ to your message "),
        moment(5, "Kai", videos=[{"uri": "one.mov"}, {"uri": "two.mov"}], content=""),
        moment(6, "Kai", content="中 stays as it is"),
        moment(7, "JosÃ©", content="Kai sent an attachment."),
        twice,
        moment(8, "JosÃ©", share={"share_text": "a page"}, content="see"),
        twice,
        moment(9, "JosÃ©", photos=[{"uri": "sky.heic"}], content="blue"),
    ]
    deep = tmp_path / "inbox" / "jose"
    deep.mkdir(parents=True)
    (deep / "message_7.json").write_text(json.dumps({"title": "JosÃ©", "messages": moments}))
    (deep / "message_8.json").write_text('{"title": "no list"}')
    (deep / "photos.json").write_text("{}")
    (tmp_path / "message_1.json").write_text("[[")
    rows, bad = exports.read_threads(spark, str(tmp_path))
    got = rows.orderBy("position").collect()
    assert [(r.sender_external_id, r.media_type, r.text, r.media_url) for r in got] == [
        ("Kai", "voice", None, "hum.aac"),
        ("José", "text", "läuft – gut", None),
        ("Kai", "video", None, "one.mov"),
        ("Kai", "text", "中 stays as it is", None),
        ("Kai", "text", "again", None),
        ("Kai", "text", "again", None),
        ("José", "image", "blue", "sky.heic"),
    ]
    assert len({r.external_id for r in got}) == 7 and {r.conversation_id for r in got} == {"José"} and bad.count() == 2
    assert got[4].timestamp == dt.datetime(2022, 8, 8, 22, 50, 0, 123000)


def event(spark, **kw):
    base = dict(id="1", chat="5@s.whatsapp.net", sender="5:2@s.whatsapp.net", sender_alt=None, recipient_alt=None, from_me=False, is_edit=False, timestamp=None, kind="message", conversation="hi", extended=None, image=None, video=None, audio=None)
    return spark.createDataFrame([tuple({**base, **kw}.values())], live.EVENT)


@pytest.mark.parametrize(
    ("change", "reason"),
    [({}, None), ({"chat": "1@g.us"}, "group"), ({"chat": "status@broadcast"}, "status_broadcast"), ({"chat": "9@broadcast"}, "broadcast_list"), ({"chat": "1@newsletter"}, "newsletter"), ({"is_edit": True}, "edit"), ({"conversation": None}, "unsupported_type"), ({"conversation": None, "audio": ("u",)}, "voice_unsupported_live"), ({"kind": "history_sync"}, "history_sync")],
)
def test_drop_reasons(spark, change, reason):
    df = event(spark, **change)
    assert df.select(live.drop_reason().alias("r")).first().r == reason
    assert live.normalise(df).count() == (reason is None)


def test_hidden_senders(spark):
    ids = spark.createDataFrame([("7@lid", "70@s.whatsapp.net")], "hidden string, person string")

    def who(**kw):
        r = live.canonical(event(spark, **kw), ids, "me@s.whatsapp.net").first()
        return r.sender, r.chat, r.unmapped

    assert who() == ("5@s.whatsapp.net", "5@s.whatsapp.net", 0)
    assert who(sender="7:1@lid") == ("70@s.whatsapp.net", "5@s.whatsapp.net", 0)
    assert who(sender="8@lid", sender_alt="80:3@s.whatsapp.net")[0] == "80@s.whatsapp.net"
    assert who(sender="9@lid", chat="9@lid") == ("9@lid", "9@lid", 2)
    assert who(from_me=True, sender="1@lid")[0] == "me@s.whatsapp.net"


def test_model_seams(spark):
    df = spark.createDataFrame([(1, "CANDIDATE yes", bytearray(b"ok")), (2, "noise", bytearray(b"bad")), (3, None, None)], "id int, text string, content binary")
    assert {r.id for r in df.filter(M.triager(lambda p: p.lower())(F.col("text"))).collect()} == {1}
    v = df.select(M.embedder(M.hash_embedding(4), "doc: ")(F.col("text")).alias("v")).collect()
    assert len({tuple(r.v) for r in v}) == 3 and len(v[0].v) == 4

    def local(audio):
        if audio == b"bad":
            raise RuntimeError("busy")
        return {"text": "local", "language": "en", "segments": [{"avg_logprob": -0.1}]}

    got = M.transcribe_with_policy(df.filter("id < 3"), M.transcriber(local), M.transcriber(lambda a: {"text": "large", "segments": []})).orderBy("id").collect()
    assert [(r.transcription.text, r.escalated) for r in got] == [("local", False), ("large", True)]
    with pytest.raises(ValueError):
        M.audio_path("/x", "../y.opus")
    with pytest.raises(ValueError):
        M.read_bounded(b"x" * 11, 10)
    assert M.read_bounded(__import__("gzip").compress(b"abc")) == b"abc" and b"abc" not in M.summary(200, "t", b"abc").encode()


def test_a_restarting_server_is_asked_once_more(spark):
    def run(answers, audio=b"x"):
        left, waits = list(answers), []

        def call(_):
            a = left.pop(0)
            if isinstance(a, Exception):
                raise a
            return {"text": a, "segments": []}

        one = M.transcriber(call, wait=30, sleep=waits.append)
        df = spark.createDataFrame([(bytearray(audio),)], "a binary").coalesce(1)
        return df.select(one(F.col("a")).alias("t")).first().t

    assert run([M.Upstream(502), "yes"]).text == "yes"
    assert run([M.Upstream(502), M.Upstream(502)]).error == "status 502"
    assert run([M.Upstream(500), "never asked"]).error == "status 500"
    assert run([M.Cancelled(), "never asked"]).error == "cancelled"


def test_cancelled_calls_go_nowhere_and_arabic_is_told(spark):
    df = spark.createDataFrame([(1, bytearray(b"gone")), (2, bytearray(b"ar"))], "id int, content binary")

    def local(audio):
        if audio == b"gone":
            raise M.Cancelled
        return {"text": "?", "language": "Arabic", "segments": []}

    def larger(audio, language=None):
        return {"text": f"hint {language}", "segments": []}

    got = M.transcribe_with_policy(df, M.transcriber(local), M.transcriber(larger)).orderBy("id").collect()
    assert [(r.transcription.text, r.transcription.error, r.escalated) for r in got] == [(None, "cancelled", False), ("hint ar", None, True)]


def test_a_failed_embedding_does_not_stop_the_others(spark):
    m = spark.createDataFrame([(1, "a", None), (2, None, "spoken"), (3, "", None), (4, "bad", None), (5, "have", None), (5, "have", None)], "id long, raw_text string, transcript string")
    have = spark.createDataFrame([(5, [1.0])], "message_id long, vector array<float>")

    def call(texts):
        if "bad" in texts:
            raise RuntimeError
        return [[float(len(t))] for t in texts]

    new, counts = M.embed_missing(m, have, M.careful_embedder(call))
    assert {r.message_id: r.vector for r in new.collect()} == {1: [1.0], 2: [6.0]}
    assert counts.first().asDict() == {"embedded": 2, "already_embedded": 1, "skipped_no_text": 1, "failed": 1}
    again, _ = M.embed_missing(m, have, M.careful_embedder(call), rebuild=True)
    assert {r.message_id for r in again.collect()} == {1, 2, 5}
    with pytest.raises(ValueError):
        M.embed_missing(m, have, None)
