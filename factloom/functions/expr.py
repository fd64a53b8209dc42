"""Scalar functions as column expressions.  All of them stay in generated code: none calls Python for a row."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import schema as S

DAY = 86_400_000_000
EPOCH = "1970-01-01 00:00:00"
#: Fixed value: the namespace of deterministic conversation ids.
NAMESPACE = uuid.UUID("d29049a1-9c60-4b0e-8d1f-9c2d9a6e6b2a")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone (session zone: UTC)."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), ts)


def as_of_micros(as_of: str) -> Column:
    return micros(F.lit(as_of).cast("timestamp_ntz"))


def lookup(key: Column, values: dict[str, float]) -> Column:
    """The value of a key; null for a key that isn't there."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def strip(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# --- confidence --------------------------------------------------------------------------------------------------


def effective_confidence(as_of: str, confidence="confidence", rate="decay_rate", last="last_reinforced", locked="decay_locked") -> Column:
    """confidence * exp(-rate * days since last), with days at least 0; a locked fact doesn't decay."""
    days = F.greatest(F.lit(0), as_of_micros(as_of) - micros(F.col(last))) / F.lit(float(DAY))
    return F.when(F.col(locked), F.col(confidence)).otherwise(F.col(confidence) * F.exp(-F.col(rate) * days))


def default_decay_rate(predicate: Column) -> Column:
    return F.coalesce(lookup(predicate, S.DECAY_RATES), F.lit(S.SLOW))


def source_weight(source_type: Column) -> Column:
    """The source's weight; an unknown source is an error."""
    w = lookup(source_type, S.SOURCE_WEIGHTS)
    return F.when(w.isNull(), F.raise_error(F.concat(F.lit("unknown source type: "), F.coalesce(source_type, F.lit("null")))).cast("double")).otherwise(w)


def weighted_confidence(confidence: Column, source_type: Column) -> Column:
    return confidence * source_weight(source_type)


def reconstructed_confidence(confidence: Column, weight: Column) -> Column:
    """What the model had said before weighting; 0 where the weight is 0."""
    return F.coalesce(F.try_divide(confidence, F.nullif(weight, F.lit(0.0))), F.lit(0.0))


def event_tense(predicate: Column, event_time: Column, as_of: str) -> Column:
    """A future event whose time has passed is a past event."""
    over = (predicate == "event_future") & (micros(event_time) < as_of_micros(as_of))
    return F.when(over, F.lit("event_past")).otherwise(predicate)


# --- similarity --------------------------------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for vectors without length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def tokens(text: Column) -> Column:
    """Distinct lower-case words; whatever is no letter, digit or space separates them."""
    cleaned = F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}\s]", " ")
    return F.array_distinct(F.filter(F.split(cleaned, r"\s+"), lambda w: w != ""))


def dice(a: Column, b: Column) -> Column:
    """2 * common / (words of a + words of b) over token arrays; 1 if both are empty, 0 if one is."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / F.nullif(total, F.lit(0)))


def same_object(a_id: Column, a_literal: Column, b_id: Column, b_literal: Column) -> Column:
    """By entity if both have one, else by literal (case counts) if both have one, else not the same."""
    return F.coalesce(a_id == b_id, a_literal == b_literal, F.lit(False))


# --- closeness ---------------------------------------------------------------------------------------------------


def frequency_norm(f: Column) -> Column:
    return f / (f + 1.0)


def reply_speed_norm(seconds: Column) -> Column:
    return F.when(seconds < 0, 0.0).otherwise(1.0 / (1.0 + seconds / 1800.0))


def recency_norm(last_micros: Column, as_of: str) -> Column:
    days = F.greatest(F.lit(0), as_of_micros(as_of) - last_micros) / F.lit(float(DAY))
    return F.when(last_micros.isNull(), 0.0).otherwise(F.exp(-days / 14.0))


def explicit_norm(n: Column) -> Column:
    return F.least(F.lit(1.0), n / 5.0)


def closeness(frequency: Column, reply_seconds: Column, last_micros: Column, signals: Column, as_of: str) -> Column:
    """Weights 0.30, 0.25, 0.20 (humour, which nothing measures), 0.15 and 0.10."""
    return 0.30 * frequency_norm(frequency) + 0.25 * reply_speed_norm(reply_seconds) + 0.15 * recency_norm(last_micros, as_of) + 0.10 * explicit_norm(signals)


# --- identifiers and text ----------------------------------------------------------------------------------------


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """A version 5 UUID of a name, by SHA-1, without a Python function."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.substr(variant, nibble + 1, F.lit(1)), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def conversation_id(platform: Column, external: Column) -> Column:
    return uuid5(F.concat(platform, F.lit(":"), external))


def external_id(prefix: str, conversation: Column, sender: Column, rfc3339: Column, body: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("|", conversation, sender, rfc3339, body), 256))


def repeated_external_id(prefix: str, base: Column, n: Column) -> Column:
    """The first keeps its id; the n-th gets one from id#n."""
    return F.when(n > 1, F.concat(F.lit(prefix), F.sha2(F.concat(base, F.lit("#"), n.cast("string")), 256))).otherwise(base)


def usable_text(raw="raw_text", transcript="transcript") -> Column:
    """The text, else the transcript, whichever isn't empty; null if neither."""
    return F.coalesce(nonempty(F.col(raw)), nonempty(F.col(transcript)))


def speaker(is_self: Column, self_name: Column, fallback: Column) -> Column:
    return F.when(is_self, self_name).otherwise(fallback)


def edge_label(predicate: Column, object_name: Column) -> Column:
    return F.concat(predicate, F.lit(": "), object_name)


def object_entity_type(predicate: Column) -> Column:
    return F.when(predicate.isin("family_member_of", "pet_of"), F.lit("person")).otherwise(F.lit("object"))


def window_source_type(media_types: Column) -> Column:
    """voice_transcript with any voice, whatsapp_text if all is text; anything else is an error."""
    bad = F.exists(media_types, lambda m: ~m.isin("text", "voice"))
    return F.when(bad, F.raise_error(F.lit("window with a media type that has no text"))).when(F.array_contains(media_types, "voice"), F.lit("voice_transcript")).otherwise(F.lit("whatsapp_text"))


def keep_last_four(s: Column) -> Column:
    """An ellipsis and the last four characters (all, if there are no more)."""
    return F.concat(F.lit("\u2026"), F.right(s, F.lit(4)))


def cut_digits(s: Column) -> Column:
    """Runs of eight digits or more as an ellipsis and their last four."""
    return F.regexp_replace(s, "[0-9]{4,}([0-9]{4})", "\u2026$1")


def prompt_line(i: Column, ts: Column, who: Column, text: Column) -> Column:
    return F.to_json(F.struct(i.alias("i"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("ts"), who.alias("speaker"), text.alias("text")))


def prompt(template: str, lines: Column) -> Column:
    """The template with {vocabulary} and {messages} filled in."""
    head, tail = template.replace("{vocabulary}", ", ".join(S.PREDICATES)).split("{messages}")
    return F.concat(F.lit(head), F.array_join(lines, "\n"), F.lit(tail))


def strip_fence(s: Column) -> Column:
    """Model output without the code fence around it."""
    t = strip(s)
    inner = F.regexp_replace(F.regexp_replace(t, r"^```(json)?", ""), r"```$", "")
    return F.when(t.startswith("```"), strip(inner)).otherwise(t)


def part_name(file: Column) -> Column:
    return F.regexp_replace(file, r"\.opus$", ".ogg")


def backoff(attempt: Column, base: float, most: float, jitter: Column) -> Column:
    """Seconds to wait before an attempt (from 0): base doubled each time, `most` at most, by 0.8 to 1.2 as jitter goes from 0 to 1."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(60))), F.lit(float(most))) * (0.8 + 0.4 * jitter)


def repair_mojibake(s: Column) -> Column:
    """UTF-8 read as Latin-1 is read anew, if all characters are bytes and these are valid UTF-8."""
    raw = F.encode(F.when(~s.rlike(r"[^\x{00}-\x{FF}]"), s), "ISO-8859-1")
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), s)


def normalise_identity(s: Column) -> Column:
    """A person's chat id, a phone number as such an id, or a label of three characters or more; else null."""
    t = strip(s)
    user, server = F.regexp_replace(F.regexp_extract(t, r"^([^@]*)@(.*)$", 1), r"[.:].*$", ""), F.regexp_extract(t, r"^([^@]*)@(.*)$", 2)
    server = F.when(server == "c.us", F.lit("s.whatsapp.net")).otherwise(server)
    digits = F.regexp_replace(t, "[^0-9]", "")
    return (
        F.when(t.contains("@"), F.when((user != "") & server.isin("s.whatsapp.net", "lid"), F.concat(user, F.lit("@"), server)))
        .when(t.rlike(r"^\+?[0-9][0-9 ().\-]*$"), F.when(F.length(digits).between(7, 15), F.concat(digits, F.lit("@s.whatsapp.net"))))
        .when(F.length(t) >= 3, t)
    )
