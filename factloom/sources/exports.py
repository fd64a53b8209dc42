"""Chat exports: text files of header lines, and JSON threads."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import expr as X

# The line formats, markers and endings that exports use.
SPACES = " \u00a0\u202f"
STAMP = rf"^\u200e?\[?(\d{{1,2}}/\d{{1,2}}/\d{{2,4}}),[{SPACES}]?(\d{{1,2}}:\d{{2}}(?::\d{{2}})?(?:[{SPACES}]?[APap][Mm])?)\]?[{SPACES}]*[-\u2013]?"
HEADER = re.compile(rf"{STAMP}[{SPACES}]*([^:\n]{{1,60}}?):[{SPACES}](.*)$")
NOTICE = re.compile(rf"{STAMP}[{SPACES}]")
OMITTED = {"image omitted": "image", "video omitted": "video", "audio omitted": "voice"}
ENDINGS = {
    "jpg": "image", "jpeg": "image", "png": "image", "webp": "image",
    "mp4": "video", "mov": "video", "3gp": "video", "avi": "video",
    "opus": "voice", "m4a": "voice", "mp3": "voice", "ogg": "voice", "aac": "voice", "wav": "voice",
}
SYSTEM = r"(?s)^(Reacted .+ to your message\s*|Liked a message|.+ sent an attachment\.|You opened this chat through an ad\..*)$"
TEXT_PREFIX, JSON_PREFIX = "wa-export:", "ig-export:"
TOLERANCE = dt.timedelta(minutes=1)


def parse_stamp(date: str, clock: str) -> dt.datetime | None:
    """Day, month and year (two digits: 2000 on), with months and days beyond their range carried over; null if the clock
    can't be read."""
    day, month, year = (int(x) for x in date.split("/"))
    m = re.fullmatch(r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?: ?([AP])M)?", re.sub("[\u00a0\u202f]", " ", clock).strip().upper())
    if not m:
        return None
    hour, minute, second = int(m[1]), int(m[2]), int(m[3] or 0)
    if minute > 59 or second > 59 or (m[4] and not 1 <= hour <= 12) or hour > 23:
        return None
    if m[4]:
        hour = hour % 12 + 12 * (m[4] == "P")
    y, mm = divmod((year + 2000 if year < 100 else year) * 12 + month - 1, 12)
    return dt.datetime(y, mm + 1, 1, hour, minute, second) + dt.timedelta(days=day - 1)


def split_export(text: str) -> Iterator[tuple[str, str, str, str]]:
    """(date, clock, sender, body) of each message in file order.

    A header line earlier than the open message, by more than a minute, is a line that someone wrote to look like one:
    it continues the message.  Time-stamped lines without a sender are notices and end the open message.
    """
    open_: list | None = None
    for line in text.replace("\r\n", "\n").removesuffix("\n").split("\n"):
        m = HEADER.match(line)
        if m and open_:
            new, old = parse_stamp(m[1], m[2]), parse_stamp(open_[0], open_[1])
            if new and old and new < old - TOLERANCE:
                m = None
                open_[3].append(line)
                continue
        if m:
            if open_:
                yield (*open_[:3], "\n".join(open_[3]))
            open_ = [m[1], m[2], m[3], [m[4]]]
        elif NOTICE.match(line):
            if open_:
                yield (*open_[:3], "\n".join(open_[3]))
            open_ = None
        elif open_:
            open_[3].append(line)
    if open_:
        yield (*open_[:3], "\n".join(open_[3]))


def split_files(files: DataFrame) -> DataFrame:
    """files: conversation_id, value (a whole file).  conversation_id, position, date, clock, sender, body, stamp."""

    def run(batches):
        for pdf in batches:
            for conv, text in zip(pdf.conversation_id, pdf.value, strict=True):
                rows = [(conv, i, *r, parse_stamp(r[0], r[1])) for i, r in enumerate(split_export(text or ""))]
                yield pd.DataFrame(rows, columns=["conversation_id", "position", "date", "clock", "sender", "body", "stamp"]).astype({"stamp": "datetime64[us]"})

    return files.select("conversation_id", "value").mapInPandas(run, "conversation_id string, position int, date string, clock string, sender string, body string, stamp timestamp_ntz")


def classified(body: Column) -> Column:
    """media_type (null: dropped), text and media_url of a body."""
    bare = X.strip(F.regexp_replace(body, "^\u200e", ""))
    first = F.regexp_replace(F.substring_index(body, "\n", 1), "^\u200e", "")
    attached = r"^\x{200E}?(\S+\.(\w+))\s\(file attached\)$"
    file, ending = F.regexp_extract(first, attached, 1), F.lower(F.regexp_extract(first, attached, 2))
    kind = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])[ending]
    omitted = F.create_map(*[F.lit(x) for kv in OMITTED.items() for x in kv])[F.lower(bare)]
    caption = X.nonempty(X.strip(F.when(body.contains("\n"), F.expr("substring(body, instr(body, '\n') + 1)"))))
    nothing = F.lit(None).cast("string")

    def row(m: Column, t: Column, u: Column) -> Column:
        return F.struct(m.alias("media_type"), t.alias("text"), u.alias("media_url"))

    bad_file = kind.isNull() | file.contains("/") | file.contains("\\")
    return (
        F.when(omitted.isNotNull(), row(omitted, nothing, nothing))
        .when(bare.rlike("(?i)^[a-z]+(?: [a-z]+)? omitted$"), row(nothing, nothing, nothing))
        .when((file != "") & bad_file, row(nothing, nothing, nothing))
        .when(file != "", row(kind, caption, file))
        .when((bare == "") | (F.lower(bare) == "<media omitted>"), row(nothing, nothing, nothing))
        .otherwise(row(F.lit("text"), body, nothing))
    )


def with_external_ids(rows: DataFrame, prefix: str, body: Column, *order: str, file: str = "conversation_id") -> DataFrame:
    """external_id of each message; repeated ones of a file are numbered in order.  rows: conversation_id, sender, stamp."""
    base = X.external_id(prefix, F.col("conversation_id"), F.col("sender"), F.concat(F.date_format("stamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), body)
    n = F.row_number().over(Window.partitionBy(file, "__base").orderBy(*order))
    return rows.withColumn("__base", base).withColumn("external_id", X.repeated_external_id(prefix, F.col("__base"), n)).drop("__base")


def _raw(rows: DataFrame, platform: str) -> DataFrame:
    return rows.select("external_id", F.lit(platform).alias("platform"), "conversation_id", F.col("sender").alias("sender_external_id"), F.col("stamp").alias("timestamp"), "media_type", "text", "media_url", "position")


def parse_text_exports(files: DataFrame, zone: str = "UTC") -> DataFrame:
    """Messages of text exports, with their position in the file.  zone: where the clock times of the export were taken."""
    return text_messages(split_files(files), zone)


def text_messages(split: DataFrame, zone: str = "UTC") -> DataFrame:
    """Messages of what `split_files` gives, or `large_exports.split_lines`."""
    rows = split.filter("stamp IS NOT NULL").withColumn("stamp", F.to_utc_timestamp("stamp", zone).cast("timestamp_ntz"))
    rows = rows.withColumn("c", classified(F.col("body"))).filter("c.media_type IS NOT NULL")
    rows = rows.select("conversation_id", "position", "sender", "body", "stamp", "c.*")
    return _raw(with_external_ids(rows, TEXT_PREFIX, F.col("body"), "position"), "whatsapp")


def read_text_exports(spark: SparkSession, folder: str, zone: str = "UTC") -> DataFrame:
    """All *.txt of a folder (not below it); the file's name without ending is the conversation."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)  # as an option it would be overridden
    return parse_text_exports(files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("conversation_id"), "value"), zone)


REF = "array<struct<uri:string>>"
THREAD = f"thread_path string, title string, messages array<struct<sender_name:string,timestamp_ms:bigint,content:string,is_unsent:boolean,photos:{REF},videos:{REF},audio_files:{REF},share:struct<link:string,share_text:string>,reactions:array<struct<reaction:string,actor:string>>>>, _corrupt_record string"


def classified_json(m: Column) -> Column:
    """media_type (null: dropped), text and media_url of a thread's message; the first rule that fits."""
    text, nothing = X.repair_mojibake(F.coalesce(m["content"], F.lit(""))), F.lit(None).cast("string")

    def some(c: Column) -> Column:
        return F.coalesce(F.size(c) > 0, F.lit(False))

    def row(k: Column, t: Column, u: Column) -> Column:
        return F.struct(k.alias("media_type"), t.alias("text"), u.alias("media_url"))

    empty, drop = F.coalesce(m["content"], F.lit("")) == "", row(nothing, nothing, nothing)
    return (
        F.when(F.coalesce(m["is_unsent"], F.lit(False)), drop)
        .when(some(m["photos"]), row(F.lit("image"), X.nonempty(text), F.get(m["photos"], 0)["uri"]))
        .when(some(m["videos"]), row(F.lit("video"), X.nonempty(text), F.get(m["videos"], 0)["uri"]))
        .when(some(m["audio_files"]), row(F.lit("voice"), nothing, F.get(m["audio_files"], 0)["uri"]))
        .when(m["share"].isNotNull() | empty | m["content"].rlike(SYSTEM), drop)
        .otherwise(row(F.lit("text"), text, nothing))
    )


def parse_threads(threads: DataFrame) -> DataFrame:
    """Messages of JSON threads in file order; the thread's path, else its title, is the conversation."""
    conv = F.coalesce(X.nonempty(F.col("thread_path")), X.repair_mojibake(F.col("title")))
    file = "file" if "file" in threads.columns else "thread_path"
    rows = threads.select(conv.alias("conversation_id"), F.col(file).alias("file"), F.posexplode("messages").alias("position", "m"))
    rows = rows.withColumn("c", classified_json(F.col("m"))).filter("c.media_type IS NOT NULL")
    rows = rows.select("conversation_id", "file", "position", F.coalesce("m.content", F.lit("")).alias("content"), X.repair_mojibake(F.col("m.sender_name")).alias("sender"), F.timestamp_millis("m.timestamp_ms").cast("timestamp_ntz").alias("stamp"), "c.*")
    return _raw(with_external_ids(rows, JSON_PREFIX, F.col("content"), "position", file="file"), "instagram")


def read_threads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Messages of all message_*.json in and below a folder, and the files that can't be read or have no list of messages."""
    raw = spark.read.schema(THREAD).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "message_*.json").option("mode", "PERMISSIVE").json(folder)
    raw = raw.withColumn("file", F.col("_metadata.file_path"))
    return parse_threads(raw.filter("_corrupt_record IS NULL AND messages IS NOT NULL")), raw.filter("_corrupt_record IS NOT NULL OR messages IS NULL").select("file")
