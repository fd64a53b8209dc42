"""The driver's tables seen as messages, edges, entities and windows, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schema as S

AS_OF = "2024-02-15 00:00:00"
SELF = -1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("user_id") % 5 == 0, 1_000_000 + F.col("user_id") % 25).otherwise(F.col("user_id")).alias("conversation_id"),
        F.when(kind.isin("view", "click"), F.lit(SELF)).otherwise(F.col("user_id")).cast("long").alias("sender_id"),
        F.when(kind == "error", "voice").when(kind == "signup", "image").otherwise("text").alias("media_type"),
        F.when(~kind.isin("error", "signup"), F.col("props")).alias("raw_text"),
        F.when((kind == "error") & (F.col("event_id") % 3 != 0), F.col("props")).alias("transcript"),
        (F.col("event_id") % 4 != 0).alias("processed"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_id") % 10 != 0, F.concat(kind, F.lit(":"), F.floor("value").cast("string"))).alias("external_id"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    predicate = F.create_map(*[F.lit(x) for x in ("click", "likes", "view", "event_present", "purchase", "goal_is", "signup", "nickname_is", "error", "mood_signal")])[F.col("event_type")]
    source = F.when(e % 20 == 0, S.USER_DELETION).when(e % 20 == 1, S.USER_CORRECTION).when(e % 20 == 2, "voice_transcript").otherwise("whatsapp_text")
    n = read(spark, sf_dir, "embeddings").agg(F.count("*")).scalar() + 10
    return read(spark, sf_dir, "events").select(
        e.alias("id"),
        F.col("user_id").alias("subject_id"),
        predicate.alias("predicate"),
        F.when(e % 3 == 0, e % 100).alias("object_id"),
        F.when(e % 3 != 0, F.col("props")).alias("object_literal"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        ((e % 100) / 100).alias("importance"),
        source.alias("source_type"),
        F.array(e % n, (e + 7) % n).alias("source_message_ids"),
        F.col("ts").alias("first_seen"),
        (F.col("ts") + F.expr("interval 1 hour")).alias("last_reinforced"),
        F.coalesce(F.create_map(*[F.lit(x) for kv in S.DECAY_RATES.items() for x in kv])[predicate], F.lit(S.SLOW)).alias("decay_rate"),
        (e % 20 == 1).alias("decay_locked"),
        F.when(e % 11 == 0, e + 1).alias("superseded_by"),
        (e % 20 == 1).alias("is_correction"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("person").alias("type"), F.col("c_name").alias("canonical_name"), F.lit(False).alias("is_self"))
    me = spark.range(1).select(F.lit(SELF).cast("long").alias("id"), F.lit("person").alias("type"), F.lit("Self").alias("canonical_name"), F.lit(True).alias("is_self"))
    return people.unionByName(me)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("message_id"), F.col("embedding").alias("vector"))


SQL = """
WITH messages AS (
  SELECT event_id AS id, CASE WHEN user_id % 5 = 0 THEN 1000000 + user_id % 25 ELSE user_id END AS conversation_id,
         CASE WHEN event_type IN ('view', 'click') THEN -1 ELSE user_id END AS sender_id,
         CASE event_type WHEN 'error' THEN 'voice' WHEN 'signup' THEN 'image' ELSE 'text' END AS media_type,
         CASE WHEN event_type NOT IN ('error', 'signup') THEN props END AS raw_text,
         CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN props END AS transcript,
         event_id % 4 <> 0 AS processed, ts AS timestamp,
         CASE WHEN event_id % 10 <> 0 THEN event_type || ':' || floor(value)::BIGINT END AS external_id
  FROM events),
edges AS (
  SELECT event_id AS id, user_id AS subject_id,
         CASE event_type WHEN 'click' THEN 'likes' WHEN 'view' THEN 'event_present' WHEN 'purchase' THEN 'goal_is'
                         WHEN 'signup' THEN 'nickname_is' WHEN 'error' THEN 'mood_signal' END AS predicate,
         CASE WHEN event_id % 3 = 0 THEN event_id % 100 END AS object_id,
         CASE WHEN event_id % 3 <> 0 THEN props END AS object_literal,
         least(value / 100, 1.0) AS confidence, (event_id % 100) / 100 AS importance,
         CASE event_id % 20 WHEN 0 THEN 'user_deletion' WHEN 1 THEN 'user_correction' WHEN 2 THEN 'voice_transcript' ELSE 'whatsapp_text' END AS source_type,
         [event_id % (n + 10), (event_id + 7) % (n + 10)] AS source_message_ids,
         ts AS first_seen, ts + INTERVAL 1 HOUR AS last_reinforced,
         CASE event_type WHEN 'click' THEN 0.0001 WHEN 'signup' THEN 0.0001 WHEN 'error' THEN 2.7726 ELSE 0.004621 END::DOUBLE AS decay_rate,
         event_id % 20 = 1 AS decay_locked, CASE WHEN event_id % 11 = 0 THEN event_id + 1 END AS superseded_by,
         event_id % 20 = 1 AS is_correction
  FROM events, (SELECT count(*) AS n FROM embeddings)),
entities AS (
  SELECT c_custkey AS id, 'person' AS type, c_name AS canonical_name, false AS is_self FROM customer
  UNION ALL SELECT -1, 'person', 'Self', true),
decayed AS (
  SELECT *, CASE WHEN decay_locked THEN confidence ELSE confidence * exp(-decay_rate * greatest(0, epoch_us(TIMESTAMP '2024-02-15') - epoch_us(last_reinforced)) / 86400000000.0) END AS eff
  FROM edges)
"""
