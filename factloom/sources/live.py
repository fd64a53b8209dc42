"""Events of a live chat connection: what is dropped and why, whose they are, and what they say.  Batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import expr as X

EVENT = "id string, chat string, sender string, sender_alt string, recipient_alt string, from_me boolean, is_edit boolean, timestamp timestamp, kind string, conversation string, extended struct<text:string>, image struct<caption:string,url:string>, video struct<caption:string,url:string>, audio struct<url:string>"
# Servers of chat ids.
PERSON, HIDDEN, GROUP, BROADCAST, NEWSLETTER = "s.whatsapp.net", "lid", "g.us", "broadcast", "newsletter"


def media_type() -> Column:
    return (
        F.when(F.coalesce("conversation", F.lit("")) != "", "text")
        .when(F.col("extended").isNotNull(), "text")
        .when(F.col("image").isNotNull(), "image")
        .when(F.col("video").isNotNull(), "video")
        .when(F.col("audio").isNotNull(), "voice")
    )


def user(jid: Column) -> Column:
    return F.substring_index(jid, "@", 1)


def server(jid: Column) -> Column:
    return F.substring_index(jid, "@", -1)


def bare(jid: Column) -> Column:
    """An id without its device."""
    return F.concat(F.regexp_replace(user(jid), r"[.:].*$", ""), F.lit("@"), server(jid))


def drop_reason(stopped: bool = False) -> Column:
    """Why an event is dropped, by the first rule that fits; null if it isn't."""
    chat = F.col("chat")
    return (
        F.when(F.lit(stopped), "after_stop")
        .when(F.col("kind") == "history_sync", "history_sync")
        .when(server(chat) == GROUP, "group")
        .when((server(chat) == BROADCAST) & (user(chat) == "status"), "status_broadcast")
        .when(server(chat) == BROADCAST, "broadcast_list")
        .when(server(chat) == NEWSLETTER, "newsletter")
        .when(F.col("is_edit"), "edit")
        .when(media_type().isNull(), "unsupported_type")
        .when(media_type() == "voice", "voice_unsupported_live")
    )


def canonical(events: DataFrame, id_map: DataFrame, me: str) -> DataFrame:
    """sender and chat as persons' ids: one's own messages are one's own, hidden ids go by the event's other id, else by the
    map (hidden, person), else stay (unmapped counts them)."""
    chat_alt = F.when(F.col("from_me"), F.col("recipient_alt")).otherwise(F.col("sender_alt"))
    out = events.withColumns({"__chat_alt": chat_alt, "unmapped": F.lit(0)})
    for c, alt in (("sender", "sender_alt"), ("chat", "__chat_alt")):
        known = id_map.select(bare(F.col("hidden")).alias(f"__{c}"), bare(F.col("person")).alias("__person"))
        out = out.withColumn(f"__{c}", bare(F.col(c))).join(known, f"__{c}", "left")
        hidden = server(F.col(c)) == HIDDEN
        other = F.when(server(F.col(alt)) == PERSON, bare(F.col(alt)))
        found = F.coalesce(other, "__person")
        own = F.col("from_me") if c == "sender" else F.lit(False)
        out = out.withColumn("unmapped", F.col("unmapped") + F.coalesce(hidden & found.isNull() & ~own, F.lit(False)).cast("int"))
        out = out.withColumn(c, F.when(own, F.lit(me)).when(hidden, F.coalesce(found, f"__{c}")).otherwise(F.col(f"__{c}"))).drop(f"__{c}", "__person")
    return out.drop("__chat_alt")


def normalise(events: DataFrame) -> DataFrame:
    """Events that aren't dropped as messages."""
    text = F.when(F.coalesce("conversation", F.lit("")) != "", F.col("conversation")).when(F.col("extended").isNotNull(), F.col("extended.text")).when(F.col("image").isNotNull(), X.nonempty(F.col("image.caption"))).when(F.col("video").isNotNull(), X.nonempty(F.col("video.caption")))
    url = F.when(media_type() == "image", F.col("image.url")).when(media_type() == "video", F.col("video.url")).when(media_type() == "voice", F.col("audio.url"))
    kept = events.filter(drop_reason().isNull())
    return kept.select(F.col("id").alias("external_id"), F.lit("whatsapp").alias("platform"), F.col("chat").alias("conversation_id"), F.col("sender").alias("sender_external_id"), "timestamp", media_type().alias("media_type"), text.alias("text"), url.alias("media_url"))
