"""Tables of the knowledge graph, closed vocabularies, and checks that report rows which break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 8

_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "int": T.IntegerType(),
    "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _table(columns: str) -> T.StructType:
    """A schema from `name type` pairs; no session is needed for it."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


ENTITIES = _table("id string, type string, canonical_name string, is_self boolean, metadata map<string,string>, created_at timestamp, updated_at timestamp")
EDGES = _table(
    "id string, subject_id string, predicate string, object_id string, object_literal string, confidence double, importance double, source_type string, source_weight double, "
    "source_message_ids array<string>, first_seen timestamp, last_reinforced timestamp, decay_rate double, decay_locked boolean, superseded_by string, is_correction boolean"
)
MESSAGES = _table("id string, conversation_id string, sender_id string, media_type string, raw_text string, transcript string, transcript_confidence double, media_ref string, processed boolean, timestamp timestamp, external_id string")
EMBEDDINGS = _table("id string, message_id string, vector array<float>")
RELATIONSHIP_STATS = _table("id string, contact_id string, frequency double, reply_speed double, humor_level double, closeness double, computed_at timestamp")
RAW_MESSAGE = _table("external_id string, platform string, conversation_id string, sender_external_id string, timestamp timestamp, media_type string, text string, media_url string")
TRIPLE = _table("subject string, predicate string, object string, object_type string, confidence double, is_correction boolean, correction_source_index int, replaces_object string")

# Vocabularies, weights and rates that results depend on.
ENTITY_TYPES = ("person", "topic", "place", "project", "event", "object")
MEDIA_TYPES = ("text", "voice", "image", "video")
PREDICATES = (
    "likes", "dislikes", "event_past", "event_present", "event_future", "works_at", "studied_at", "role_is", "routine_is", "goal_is", "building",
    "family_member_of", "pet_of", "nickname_is", "inside_joke_ref",
)
SOURCE_WEIGHTS = {"whatsapp_text": 1.0, "voice_transcript": 0.95, "instagram_dm": 1.0, "instagram_caption": 0.4, "instagram_story": 0.2}
USER_CORRECTION, USER_DELETION = "user_correction", "user_deletion"
STABLE, SLOW, TRANSIENT = 0.0001, 0.004621, 2.7726
DECAY_RATES = {
    "event_past": STABLE, "likes": STABLE, "dislikes": STABLE, "family_member_of": STABLE, "pet_of": STABLE, "nickname_is": STABLE, "inside_joke_ref": STABLE,
    "event_present": SLOW, "works_at": SLOW, "studied_at": SLOW, "role_is": SLOW, "routine_is": SLOW, "goal_is": SLOW, "building": SLOW,
    "event_future": STABLE, "mood_signal": TRANSIENT,
}
ACTIONS = ("created", "reinforced", "corrected", "skipped_no_correction_target", "skipped_ambiguous_correction_target", "skipped_stale")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row for each broken rule of each row of df: rule, id.  A rule holds where its condition is true."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(F.col("id"), F.explode(F.array_compact(broken)).alias("rule"))


def edge_violations(edges: DataFrame) -> DataFrame:
    """An edge's object is an entity or a literal, not both, not neither."""
    return violations(edges, {"object_xor": F.col("object_id").isNull() != F.col("object_literal").isNull(), "sources_set": F.col("source_message_ids").isNotNull()})


def message_violations(messages: DataFrame) -> DataFrame:
    return violations(messages, {"media_type": F.col("media_type").isin(*MEDIA_TYPES)})


def entity_violations(entities: DataFrame) -> DataFrame:
    """Unknown types, and every self entity if there are two or more."""
    selves = entities.filter("is_self").agg((F.count("*") <= 1).alias("few"))
    typed = violations(entities, {"type": F.col("type").isin(*ENTITY_TYPES)})
    return typed.union(entities.filter("is_self").join(F.broadcast(selves), ~F.col("few")).select("id", F.lit("one_self").alias("rule")))


def repeated_keys(df: DataFrame, *keys: str, optional: str | None = None) -> DataFrame:
    """Keys that occur more than once; rows whose optional key is null don't count."""
    rows = df.filter(F.col(optional).isNotNull()) if optional else df
    return rows.groupBy(*keys).count().filter("count > 1")


def dangling(df: DataFrame, key: str, other: DataFrame, other_key: str = "id") -> DataFrame:
    """Rows whose key is set but isn't in the other table."""
    return df.filter(F.col(key).isNotNull()).join(other.select(F.col(other_key).alias(key)), key, "left_anti")


def expect(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns in order; raises if one is missing."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)} (schema version {VERSION})")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
