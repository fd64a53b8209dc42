"""Named queries over the test tables, and the SQL that they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.functions import expr as X
from factloom.operators import analytics as A
from factloom.operators import dedup, models, mutations, reports, triples, vectors, windows
from factloom.operators import retrieval as R
from factloom.sources import exports, live
from factloom.sources import fixtures as T

AS_OF, ME = T.AS_OF, T.SELF
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; sql goes on from the common tables of fixtures.SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = T.SQL + sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def us(c: str, name: str | None = None):
    return X.micros(F.col(c)).alias(name or f"{c}_us")


LIVE = "superseded_by IS NULL AND source_type <> 'user_deletion'"
PRUNE = "NOT decay_locked AND NOT is_correction AND (eff < 0.15 OR importance < 0.1)"


# --- retrieval ---------------------------------------------------------------------------------------------------


@query(f""", pool AS (SELECT * FROM decayed WHERE {LIVE} ORDER BY last_reinforced DESC, id LIMIT 30)
SELECT id, subject_id, predicate, round(0.3 * eff + 0.2 * importance, 6) AS score FROM pool WHERE NOT ({PRUNE}) ORDER BY 0.3 * eff + 0.2 * importance DESC, last_reinforced DESC, id LIMIT 6""")
def relevant_context(spark: SparkSession, d: str) -> DataFrame:
    return R.relevant_context(T.edges(spark, d), AS_OF).select("id", "subject_id", "predicate", F.round("score", 6).alias("score"))


@query(f""", pool AS (SELECT * FROM decayed WHERE {LIVE} ORDER BY last_reinforced DESC, id LIMIT 200)
SELECT id, round(0.3 * eff + 0.2 * importance, 6) AS score FROM pool ORDER BY 0.3 * eff + 0.2 * importance DESC, last_reinforced DESC, id LIMIT 50""")
def relevant_context_pruned(spark: SparkSession, d: str) -> DataFrame:
    return R.relevant_context(T.edges(spark, d), AS_OF, top=50, include_pruned=True).select("id", F.round("score", 6).alias("score"))


@query(f"""SELECT e.id, subject_id, predicate, importance FROM edges e JOIN entities s ON s.id = subject_id
WHERE {LIVE} AND (contains(lower(canonical_name), '00001') OR contains(lower(predicate), '00001') OR contains(lower(object_literal), '00001'))
ORDER BY importance DESC, first_seen DESC, e.id LIMIT 50""")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_search(T.edges(spark, d), T.entities(spark, d), "00001").select("id", "subject_id", "predicate", "importance")


@query(f"""SELECT e.id, canonical_name FROM edges e JOIN entities s ON s.id = subject_id
WHERE {LIVE} AND (contains(lower(canonical_name), 'goal') OR contains(lower(predicate), 'goal') OR contains(lower(object_literal), 'goal'))""")
def keyword_matches(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_matches(T.edges(spark, d), T.entities(spark, d), "GOAL").select("id", F.col("subject_name").alias("canonical_name"))


@query("SELECT id, subject_id, object_id, epoch_us(first_seen) AS first_seen_us FROM edges WHERE subject_id = 7 OR object_id = 7")
def relationship_history(spark: SparkSession, d: str) -> DataFrame:
    return R.history(T.edges(spark, d), 7).select("id", "subject_id", "object_id", us("first_seen"))


@query("SELECT id, round(eff, 9) AS eff FROM decayed")
def effective_confidence(spark: SparkSession, d: str) -> DataFrame:
    return T.edges(spark, d).select("id", F.round(X.effective_confidence(AS_OF), 9).alias("eff"))


@query(f"SELECT id FROM decayed WHERE {PRUNE}")
def prune_candidates(spark: SparkSession, d: str) -> DataFrame:
    return T.edges(spark, d).filter(R.prunable(AS_OF)).select("id")


@query("SELECT id, round(eff, 9) AS effective_confidence FROM decayed WHERE superseded_by IS NULL")
def batch_decay(spark: SparkSession, d: str) -> DataFrame:
    return A.batch_decay(T.edges(spark, d), AS_OF).select("id", F.round("effective_confidence", 9).alias("effective_confidence"))


@query("SELECT id, round(confidence * CASE source_type WHEN 'voice_transcript' THEN 0.95 ELSE 1.0 END, 9) AS weighted FROM edges WHERE source_type NOT LIKE 'user%'")
def source_weighted(spark: SparkSession, d: str) -> DataFrame:
    rows = T.edges(spark, d).filter(~F.col("source_type").startswith("user"))
    return rows.select("id", F.round(X.weighted_confidence(F.col("confidence"), F.col("source_type")), 9).alias("weighted"))


_DISTANCE = "list_cosine_similarity(vector::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[])"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return T.embeddings(spark, d).filter("message_id = 0").first().vector


@query(f"""SELECT message_id, round(similarity, 5) AS similarity FROM (SELECT vec_id AS message_id, {_DISTANCE.replace("vector", "embedding", 1)} AS similarity FROM embeddings JOIN messages m ON m.id = vec_id)
ORDER BY similarity DESC, message_id LIMIT 10""")
def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    found = R.semantic_search(T.embeddings(spark, d), T.messages(spark, d), _query_vector(spark, d))
    return found.select("message_id", F.round(1 - F.col("distance"), 5).alias("similarity"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return T.embeddings(spark, d).filter("message_id % 100 = 0").select(F.col("message_id").alias("query_id"), "vector")


_NEAR = """, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
near AS (SELECT query_id, vec_id AS message_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 12) AS s FROM q, embeddings)"""
_FIRST_TEN = "SELECT query_id, rank::INTEGER AS rank, message_id, round({s}, 5) AS {as_} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, message_id) AS rank FROM {rows}) WHERE rank <= 10"


@query(_NEAR + _FIRST_TEN.format(s="s", as_="similarity", rows="near"))
def vector_top_k_many(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(T.embeddings(spark, d), _asked(spark, d)).withColumn("similarity", F.round("similarity", 5))


@query(_NEAR + _FIRST_TEN.format(s="1 - s", as_="distance", rows="near JOIN (SELECT id FROM messages WHERE NOT processed) m ON m.id = message_id"))
def semantic_search_many(spark: SparkSession, d: str) -> DataFrame:
    found = vectors.semantic_search_many(T.embeddings(spark, d), T.messages(spark, d).filter("NOT processed"), _asked(spark, d))
    return found.withColumn("distance", F.round("distance", 5))


@query(_NEAR + f""", best AS (SELECT query_id, e.id, max(s) AS similarity FROM (SELECT id, unnest(source_message_ids) AS message_id FROM edges WHERE {LIVE}) e LEFT JOIN near USING (message_id) GROUP BY ALL),
all_ AS (SELECT q.query_id, d.*, best.similarity FROM q CROSS JOIN decayed d LEFT JOIN best ON best.id = d.id AND best.query_id = q.query_id WHERE {LIVE}),
pool AS (SELECT *, coalesce(similarity, 0) AS sim FROM all_ QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, last_reinforced DESC, id) <= 50)
SELECT query_id, id, round(0.5 * sim + 0.3 * eff + 0.2 * importance, 5) AS score FROM pool WHERE NOT ({PRUNE})
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY 0.5 * sim + 0.3 * eff + 0.2 * importance DESC, sim DESC, last_reinforced DESC, id) <= 10""")
def relevant_context_many(spark: SparkSession, d: str) -> DataFrame:
    got = vectors.relevant_context_many(T.edges(spark, d), T.embeddings(spark, d), _asked(spark, d), AS_OF, top=10)
    return got.select("query_id", "id", F.round("score", 5).alias("score"))


@query("SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, count(*) AS indexed, true AS enough FROM embeddings")
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the ten nearest to each query, nine in ten and more are found through the index, with the fewest probes that do."""
    embeddings, asked = T.embeddings(spark, d), _asked(spark, d)
    index = vectors.VectorIndex.build(embeddings, vectors.fit_cells(embeddings))
    probes = vectors.probes_for(index, embeddings, asked)
    share = vectors.recall(index.search(embeddings, asked, 10, probes), vectors.nearest(embeddings, asked))
    return index.rows.agg(F.count("*").alias("indexed")).select(F.lit(asked.count()).cast("long").alias("queries"), "indexed", F.lit(share >= 0.9).alias("enough"))


_BEST = f""", near AS (SELECT vec_id AS message_id, {_DISTANCE.replace("vector", "embedding", 1)} AS s FROM embeddings),
best AS (SELECT e.id, max(s) AS similarity FROM (SELECT id, unnest(source_message_ids) AS message_id FROM edges) e LEFT JOIN near USING (message_id) GROUP BY e.id)"""


@query(_BEST + " SELECT id, round(similarity, 5) AS similarity FROM best")
def edge_best_similarity(spark: SparkSession, d: str) -> DataFrame:
    return R.best_similarity(T.edges(spark, d), T.embeddings(spark, d), _query_vector(spark, d)).select("id", F.round("similarity", 5).alias("similarity"))


@query(_BEST + f""", pool AS (SELECT d.*, coalesce(similarity, 0) AS sim, similarity FROM decayed d JOIN best USING (id) WHERE {LIVE} ORDER BY similarity DESC NULLS LAST, last_reinforced DESC, id LIMIT 50)
SELECT id, round(0.5 * sim + 0.3 * eff + 0.2 * importance, 5) AS score FROM pool WHERE NOT ({PRUNE}) ORDER BY 0.5 * sim + 0.3 * eff + 0.2 * importance DESC, sim DESC, last_reinforced DESC, id LIMIT 10""")
def relevant_context_vector(spark: SparkSession, d: str) -> DataFrame:
    got = R.relevant_context(T.edges(spark, d), AS_OF, top=10, embeddings=T.embeddings(spark, d), query=_query_vector(spark, d))
    return got.select("id", F.round("score", 5).alias("score"))


# --- lookups -----------------------------------------------------------------------------------------------------


@query("SELECT id, canonical_name FROM entities WHERE id IN (3, 5, 8)")
def entities_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.by_ids(T.entities(spark, d), [3, 5, 8]).select("id", "canonical_name")


@query("SELECT id, canonical_name FROM entities WHERE lower(canonical_name) = (SELECT lower(min(canonical_name)) FROM entities WHERE id = 3) ORDER BY id LIMIT 1")
def entity_by_name(spark: SparkSession, d: str) -> DataFrame:
    name = T.entities(spark, d).filter("id = 3").first().canonical_name
    return R.entity_by_name(T.entities(spark, d), name.upper()).select("id", "canonical_name")


@query("SELECT id, (SELECT count(*) FROM entities WHERE is_self) AS selves FROM entities WHERE is_self ORDER BY id LIMIT 1")
def self_entity(spark: SparkSession, d: str) -> DataFrame:
    people = T.entities(spark, d)
    return R.self_entity(people).select("id", people.agg(F.count_if("is_self")).scalar().alias("selves"))


@query("SELECT id, superseded_by FROM edges WHERE subject_id = 7 AND predicate = 'likes'")
def facts_by_subject_predicate(spark: SparkSession, d: str) -> DataFrame:
    return R.facts_about(T.edges(spark, d), 7, "likes").select("id", "superseded_by")


@query(f"SELECT id FROM edges WHERE subject_id = 7 AND predicate = 'likes' AND {LIVE}")
def live_facts_by_subject_predicate(spark: SparkSession, d: str) -> DataFrame:
    return R.facts_about(T.edges(spark, d), 7, "likes", only_live=True).select("id")


_WANTED = """, w AS (SELECT DISTINCT subject_id, predicate, object_id, object_literal FROM edges)"""
_EQUAL = "e.subject_id = w.subject_id AND e.predicate = w.predicate AND coalesce(e.object_id = w.object_id, e.object_literal = w.object_literal, false)"


def _wanted(edges: DataFrame) -> DataFrame:
    return edges.select("subject_id", "predicate", "object_id", "object_literal").distinct()


@query(_WANTED + f""" SELECT id, subject_id, predicate FROM (SELECT e.*, row_number() OVER (PARTITION BY e.subject_id, e.predicate, w.object_id, w.object_literal ORDER BY first_seen, id) AS n FROM edges e JOIN w ON {_EQUAL} WHERE {LIVE}) WHERE n = 1""")
def matching_live_facts(spark: SparkSession, d: str) -> DataFrame:
    edges = T.edges(spark, d)
    return R.matching_live(edges, _wanted(edges)).select("id", "subject_id", "predicate")


@query(_WANTED + f" SELECT e.id FROM edges e JOIN w ON {_EQUAL} WHERE superseded_by IS NOT NULL")
def superseded_matching_facts(spark: SparkSession, d: str) -> DataFrame:
    edges = T.edges(spark, d)
    return R.superseded_matches(edges, _wanted(edges)).select("id")


@query("SELECT id, epoch_us(timestamp) AS timestamp_us FROM messages WHERE conversation_id = 7 AND timestamp >= TIMESTAMP '2024-01-10'")
def conversation_range(spark: SparkSession, d: str) -> DataFrame:
    return R.conversation_range(T.messages(spark, d), 7, "2024-01-10 00:00:00").select("id", us("timestamp"))


# --- messages ----------------------------------------------------------------------------------------------------


@query("SELECT lower(canonical_name) AS name, count(*) AS n FROM (SELECT canonical_name FROM entities UNION ALL SELECT upper(canonical_name) FROM entities WHERE id % 50 = 0) GROUP BY 1 HAVING count(*) > 1")
def dup_name_audit(spark: SparkSession, d: str) -> DataFrame:
    e = T.entities(spark, d).select("id", "canonical_name")
    return A.repeated_names(e.union(e.filter("id % 50 = 0").select("id", F.upper("canonical_name")))).select("name", "n")


@query("SELECT id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = m.id)")
def unembedded_messages(spark: SparkSession, d: str) -> DataFrame:
    return A.without_embedding(T.messages(spark, d), T.embeddings(spark, d)).select("id")


_TEXT = "((raw_text IS NOT NULL AND raw_text <> '') OR (transcript IS NOT NULL AND transcript <> ''))"


@query(f"SELECT id, coalesce(nullif(raw_text, ''), nullif(transcript, '')) AS text FROM messages WHERE {_TEXT}")
def messages_with_text(spark: SparkSession, d: str) -> DataFrame:
    return T.messages(spark, d).select("id", X.usable_text().alias("text")).filter("text IS NOT NULL")


@query(f"SELECT id, conversation_id FROM messages WHERE NOT processed AND {_TEXT}")
def unprocessed_with_text(spark: SparkSession, d: str) -> DataFrame:
    return A.unprocessed_with_text(T.messages(spark, d)).select("id", "conversation_id")


@query(f"SELECT count(*) AS n FROM messages WHERE NOT processed AND NOT {_TEXT}")
def unprocessed_no_text_count(spark: SparkSession, d: str) -> DataFrame:
    return T.messages(spark, d).filter(~F.col("processed") & X.usable_text().isNull()).agg(F.count("*").alias("n"))


_SINCE = "timestamp >= TIMESTAMP '2024-01-18'"


@query(f"SELECT conversation_id, count(*) AS n FROM messages WHERE {_SINCE} GROUP BY 1")
def count_by_conversation(spark: SparkSession, d: str) -> DataFrame:
    return A.count_by(T.messages(spark, d), "conversation_id", since=A.since_days(AS_OF))


@query(f"SELECT conversation_id, sender_id, count(*) AS n FROM messages WHERE {_SINCE} GROUP BY 1, 2")
def count_by_conversation_sender(spark: SparkSession, d: str) -> DataFrame:
    return A.count_by(T.messages(spark, d), "conversation_id", "sender_id", since=A.since_days(AS_OF))


@query("SELECT DISTINCT conversation_id, sender_id FROM messages")
def distinct_senders(spark: SparkSession, d: str) -> DataFrame:
    return A.distinct_senders(T.messages(spark, d))


@query("SELECT DISTINCT conversation_id FROM messages WHERE sender_id = -1")
def conversations_of_sender(spark: SparkSession, d: str) -> DataFrame:
    return A.conversations_of(T.messages(spark, d), ME)


@query("SELECT conversation_id, max(epoch_us(timestamp)) AS last FROM messages GROUP BY 1")
def last_message_time(spark: SparkSession, d: str) -> DataFrame:
    return A.last_time(T.messages(spark, d), "conversation_id")


@query("SELECT conversation_id, sender_id, max(epoch_us(timestamp)) AS last FROM messages GROUP BY 1, 2")
def last_message_time_by_sender(spark: SparkSession, d: str) -> DataFrame:
    return A.last_time(T.messages(spark, d), "conversation_id", "sender_id")


@query("SELECT conversation_id, min(least(epoch_us(timestamp), epoch_us(TIMESTAMP '2024-01-20'))) AS first, max(least(epoch_us(timestamp), epoch_us(TIMESTAMP '2024-01-20'))) AS last FROM messages GROUP BY 1")
def observed_times(spark: SparkSession, d: str) -> DataFrame:
    return A.observed_times(T.messages(spark, d), "2024-01-20 00:00:00", "conversation_id")


# --- relationships -----------------------------------------------------------------------------------------------

_KINDS = """, kinds AS (SELECT conversation_id, CASE WHEN count(DISTINCT sender_id) > 1 THEN 'group' ELSE 'one_to_one' END AS kind,
  CASE WHEN count(DISTINCT sender_id) = 1 THEN min(sender_id) END AS owner FROM messages WHERE sender_id <> -1 GROUP BY 1)"""
_FREQUENCY = _KINDS + f""", credited AS (SELECT CASE WHEN kind = 'one_to_one' THEN owner ELSE nullif(sender_id, -1) END AS contact_id, sum(CASE WHEN kind = 'one_to_one' THEN n ELSE 0.25 * n END)::DOUBLE AS x
  FROM (SELECT conversation_id, sender_id, count(*) AS n FROM messages WHERE {_SINCE} GROUP BY 1, 2) JOIN kinds USING (conversation_id) GROUP BY 1 HAVING contact_id IS NOT NULL),
frequency AS (SELECT contact_id, x / (SELECT avg(x) FROM credited) AS frequency FROM credited)"""
_REPLIES = f""", lagged AS (SELECT *, lag(sender_id) OVER w AS before, lag(timestamp) OVER w AS earlier FROM messages WHERE {_SINCE} WINDOW w AS (PARTITION BY conversation_id ORDER BY timestamp, id)),
replies AS (SELECT before AS contact_id, conversation_id, kind, (epoch_us(timestamp) - epoch_us(earlier)) / 1e6 AS seconds FROM lagged JOIN kinds USING (conversation_id)
  WHERE sender_id = -1 AND before <> -1 AND (kind <> 'group' OR epoch_us(timestamp) - epoch_us(earlier) <= 1800000000))"""
_RECENCY = """, recent AS (SELECT CASE WHEN kind = 'one_to_one' THEN owner ELSE nullif(sender_id, -1) END AS contact_id, max(epoch_us(timestamp)) AS last FROM messages JOIN kinds USING (conversation_id) GROUP BY 1 HAVING contact_id IS NOT NULL)"""


@query(_KINDS + " SELECT * FROM kinds")
def classify_conversations(spark: SparkSession, d: str) -> DataFrame:
    return A.classify_conversations(T.messages(spark, d), ME)


@query(_FREQUENCY + " SELECT contact_id, round(frequency, 9) AS frequency FROM frequency")
def contact_frequency(spark: SparkSession, d: str) -> DataFrame:
    m = T.messages(spark, d)
    return A.frequency(m, A.classify_conversations(m, ME), ME, AS_OF).select("contact_id", F.round("frequency", 9).alias("frequency"))


def _latencies(spark: SparkSession, d: str) -> DataFrame:
    m = T.messages(spark, d)
    return A.reply_latencies(m, A.classify_conversations(m, ME), ME, AS_OF)


@query(_KINDS + _REPLIES + " SELECT contact_id, conversation_id, round(seconds, 6) AS seconds FROM replies")
def reply_latency(spark: SparkSession, d: str) -> DataFrame:
    return _latencies(spark, d).select("contact_id", "conversation_id", F.round("seconds", 6).alias("seconds"))


@query(_KINDS + _REPLIES + " SELECT contact_id, round(median(seconds), 3) AS reply_seconds FROM replies GROUP BY 1")
def reply_speed_median(spark: SparkSession, d: str) -> DataFrame:
    return A.reply_speed(_latencies(spark, d)).select("contact_id", F.round("reply_seconds", 3).alias("reply_seconds"))


@query(_KINDS + _RECENCY + " SELECT * FROM recent")
def recency(spark: SparkSession, d: str) -> DataFrame:
    m = T.messages(spark, d)
    return A.recency(m, A.classify_conversations(m, ME), ME)


@query(f"SELECT subject_id AS contact_id, count(*) AS signals FROM edges WHERE {LIVE} AND predicate IN ('nickname_is', 'inside_joke_ref') GROUP BY 1")
def explicit_signals(spark: SparkSession, d: str) -> DataFrame:
    return A.explicit_signals(T.edges(spark, d))


@query(_FREQUENCY + _REPLIES + _RECENCY + f""", speed AS (SELECT contact_id, median(seconds) AS s FROM replies GROUP BY 1),
signals AS (SELECT subject_id AS contact_id, count(*) AS n FROM edges WHERE {LIVE} AND predicate IN ('nickname_is', 'inside_joke_ref') GROUP BY 1)
SELECT contact_id, round(0.30 * coalesce(frequency, 0) / (coalesce(frequency, 0) + 1) + 0.25 * coalesce(1 / (1 + s / 1800), 0)
  + 0.15 * exp(-greatest(0, epoch_us(TIMESTAMP '2024-02-15') - last) / 86400000000.0 / 14) + 0.10 * least(1, coalesce(n, 0) / 5), 6) AS closeness
FROM recent LEFT JOIN frequency USING (contact_id) LEFT JOIN speed USING (contact_id) LEFT JOIN signals USING (contact_id)""")
def closeness(spark: SparkSession, d: str) -> DataFrame:
    return A.relationship_stats(T.messages(spark, d), T.edges(spark, d), ME, AS_OF).select("contact_id", F.round("closeness", 6).alias("closeness"))


# --- provenance and reports --------------------------------------------------------------------------------------

_SOURCES = """, src AS (SELECT e.id AS edge_id, m.timestamp::DATE AS day, coalesce(s.canonical_name, '') AS sender, media_type
  FROM (SELECT id, unnest(source_message_ids) AS mid FROM edges) e JOIN messages m ON m.id = e.mid LEFT JOIN entities s ON s.id = m.sender_id)"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return R.sources_of(T.edges(spark, d), T.messages(spark, d), T.entities(spark, d))


@query(_SOURCES + " SELECT edge_id, string_agg(DISTINCT day::VARCHAR, ',' ORDER BY day::VARCHAR) AS days FROM src GROUP BY 1")
def provenance_seen(spark: SparkSession, d: str) -> DataFrame:
    return R.seen_days(_sources(spark, d)).select("edge_id", F.array_join(F.transform("days", lambda x: x.cast("string")), ",").alias("days"))


@query(_SOURCES + " SELECT edge_id, string_agg(sender || '=' || n, ',' ORDER BY n DESC, sender) AS senders FROM (SELECT edge_id, sender, count(*) AS n FROM src GROUP BY 1, 2) GROUP BY 1")
def provenance_mentions(spark: SparkSession, d: str) -> DataFrame:
    return R.tally(_sources(spark, d), "sender").select("edge_id", F.array_join(F.transform("senders", lambda x: F.concat(x["name"], F.lit("="), x["n"].cast("string"))), ",").alias("senders"))


@query(_SOURCES + " SELECT edge_id, string_agg(media_type || '=' || n, ',' ORDER BY n DESC, media_type) AS media FROM (SELECT edge_id, media_type, count(*) AS n FROM src GROUP BY 1, 2) GROUP BY 1")
def provenance_media(spark: SparkSession, d: str) -> DataFrame:
    return R.tally(_sources(spark, d), "media_type").select("edge_id", F.array_join(F.transform("media_types", lambda x: F.concat(x["name"], F.lit("="), x["n"].cast("string"))), ",").alias("media"))


@query("SELECT event_type AS model, user_id % 3 AS path, count(*) AS requests, coalesce(sum(user_id), 0)::BIGINT AS total_tokens, round(coalesce(sum(value), 0), 4) AS cost, count(*) FILTER (value > 50) AS priced FROM events GROUP BY 1, 2")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("user_id")
    usage = T.read(spark, d, "events").select(F.col("event_type").alias("model"), (n % 3).alias("path"), n.alias("prompt_tokens"), n.alias("completion_tokens"), n.alias("total_tokens"), F.col("value").alias("cost"), (F.col("value") > 50).alias("price_found"))
    return reports.usage_rollup(usage).select("model", "path", "requests", "total_tokens", F.round("cost", 4).alias("cost"), "priced")


@query("""SELECT count(*) AS n, round(min(confidence), 6) AS least, round(max(confidence), 6) AS most, round(avg(confidence), 6) AS mean,
  (SELECT round(confidence, 6) FROM edges ORDER BY confidence LIMIT 1 OFFSET (SELECT count(*) // 2 FROM edges)) AS median FROM edges""")
def confidence_distribution(spark: SparkSession, d: str) -> DataFrame:
    got = reports.distribution(T.edges(spark, d))
    return got.select("n", *[F.round(c, 6).alias(c) for c in ("least", "most", "mean", "median")])


@query("(SELECT id, round(confidence, 6) AS confidence, 'low' AS side FROM edges ORDER BY edges.confidence, id LIMIT 10) UNION ALL (SELECT id, round(confidence, 6), 'high' FROM edges ORDER BY edges.confidence DESC, id LIMIT 10)")
def confidence_outliers(spark: SparkSession, d: str) -> DataFrame:
    return reports.outliers(T.edges(spark, d)).select("id", F.round("confidence", 6).alias("confidence"), "side")


@query("SELECT CASE event_id % 7 WHEN 0 THEN 'group' WHEN 1 THEN 'edit' ELSE 'unsupported_type' END AS drop_reason, count(*) AS n FROM events WHERE event_id % 7 < 3 GROUP BY 1")
def drop_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id") % 7
    return reports.drop_counts(T.read(spark, d, "events").select(F.when(e == 0, "group").when(e == 1, "edit").when(e == 2, "unsupported_type").alias("drop_reason")))


# --- windows and identifiers -------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 3)::INTEGER AS window_index FROM conversations")
def count_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.count_windows(T.read(spark, d, "conversations"), "conv_id", "turn", "role", "text", size=3).select("conv_id", "turn", "window_index")


@query()
def live_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.live_windows(T.messages(spark, d)).select("id", "conversation_id", "window_index")


_SQL["live_windows"] = T.SQL.replace("WITH messages", "WITH RECURSIVE messages", 1) + """, ordered AS (SELECT id, conversation_id, epoch_us(timestamp) AS us, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp, id) AS k FROM messages),
fold AS (
  SELECT id, conversation_id, k, us AS first, 1 AS n, 0 AS window_index FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.id, o.conversation_id, o.k,
         CASE WHEN f.n >= 10 OR o.us - f.first > 300000000 THEN o.us ELSE f.first END,
         CASE WHEN f.n >= 10 OR o.us - f.first > 300000000 THEN 1 ELSE f.n + 1 END,
         CASE WHEN f.n >= 10 OR o.us - f.first > 300000000 THEN f.window_index + 1 ELSE f.window_index END
  FROM fold f JOIN ordered o ON o.conversation_id = f.conversation_id AND o.k = f.k + 1)
SELECT id, conversation_id, window_index::INTEGER AS window_index FROM fold"""


@query(""", w AS (SELECT conversation_id, media_type, (row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp, id) - 1) // 8 AS i FROM messages WHERE media_type IN ('text', 'voice'))
SELECT conversation_id, i::INTEGER AS window_index, CASE WHEN bool_or(media_type = 'voice') THEN 'voice_transcript' ELSE 'whatsapp_text' END AS source_type FROM w GROUP BY 1, 2""")
def window_source_type(spark: SparkSession, d: str) -> DataFrame:
    rows = T.messages(spark, d).filter(F.col("media_type").isin("text", "voice"))
    return windows.window_rows(windows.count_windows(rows, "conversation_id", "timestamp", "id")).select("conversation_id", "window_index", "source_type")


def _identified(spark: SparkSession, d: str) -> DataFrame:
    rows = T.messages(spark, d).select("id", F.col("conversation_id").cast("string").alias("conversation_id"), F.col("sender_id").cast("string").alias("sender"), F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("stamp"), F.coalesce("raw_text", F.lit("")).alias("body"))
    return exports.with_external_ids(rows, exports.TEXT_PREFIX, F.col("body"), "id")


_IDS = """, ids AS (SELECT id, 'wa-export:' || sha256(conversation_id || '|' || sender_id || '|' || strftime(date_trunc('day', timestamp), '%Y-%m-%dT%H:%M:%SZ') || '|' || coalesce(raw_text, '')) AS base, conversation_id FROM messages)"""


@query(_IDS + " SELECT id, base AS external_id FROM ids")
def external_ids(spark: SparkSession, d: str) -> DataFrame:
    m = T.messages(spark, d)
    stamp = F.concat(F.date_format(F.date_trunc("day", "timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return m.select("id", X.external_id(exports.TEXT_PREFIX, F.col("conversation_id").cast("string"), F.col("sender_id").cast("string"), stamp, F.coalesce("raw_text", F.lit(""))).alias("external_id"))


@query(_IDS + ", n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM ids) SELECT id, CASE WHEN k > 1 THEN 'wa-export:' || sha256(base || '#' || k) ELSE base END AS external_id FROM n")
def external_id_disambiguation(spark: SparkSession, d: str) -> DataFrame:
    return _identified(spark, d).select("id", "external_id")


@query()
def conversation_uuid5(spark: SparkSession, d: str) -> DataFrame:
    return T.messages(spark, d).select("conversation_id").distinct().select("conversation_id", X.conversation_id(F.lit("whatsapp"), F.col("conversation_id").cast("string")).alias("uuid"))


_SQL["conversation_uuid5"] = T.SQL + f""", h AS (SELECT conversation_id, sha1(unhex('{X.NAMESPACE.hex}') || encode('whatsapp:' || conversation_id)) AS h FROM (SELECT DISTINCT conversation_id FROM messages))
SELECT conversation_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[('0x' || h[17:17])::INTEGER % 4 + 1] || h[18:20] || '-' || h[21:32] AS uuid FROM h"""


# --- duplicates and changes --------------------------------------------------------------------------------------

_PAIRS = f""", words AS (SELECT id, subject_id, predicate, object_id, epoch_us(first_seen) AS us, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(object_literal), '[^\\p{{L}}\\p{{Nd}}\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS w
  FROM edges WHERE {LIVE} AND NOT decay_locked AND NOT is_correction),
pairs AS (SELECT a.id AS a, b.id AS b FROM words a JOIN words b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.id < b.id AND abs(a.us - b.us) <= 86400000000
  AND CASE WHEN a.object_id IS NOT NULL OR b.object_id IS NOT NULL THEN coalesce(a.object_id = b.object_id, false)
      ELSE 2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) >= 0.85 END)"""


@query(_PAIRS + " SELECT a, b FROM pairs")
def literal_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_pairs(T.edges(spark, d))


_CLUSTERS = T.SQL.replace("WITH messages", "WITH RECURSIVE messages", 1) + _PAIRS + """, both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS id, a AS r FROM both_ways UNION SELECT reach.id, b FROM reach JOIN both_ways ON both_ways.a = reach.r),
clusters AS (SELECT id, min(r) AS cluster FROM reach GROUP BY id)"""


@query()
def dedup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return dedup.clusters(dedup.duplicate_links(T.edges(spark, d)))


_SQL["dedup_clusters"] = _CLUSTERS + " SELECT id, cluster FROM clusters"


@query()
def merge_survivors(spark: SparkSession, d: str) -> DataFrame:
    edges = T.edges(spark, d)
    members = dedup.cluster_members(edges, dedup.duplicate_links(edges))
    out, _ = mutations.merge_duplicates(edges, members)
    return out.join(members.filter("rank = 1").select("id"), "id", "left_semi").select("id", us("last_reinforced"), F.size("source_message_ids").cast("long").alias("sources"))


_SQL["merge_survivors"] = _CLUSTERS + """, m AS (SELECT c.cluster, e.*, row_number() OVER (PARTITION BY c.cluster ORDER BY first_seen, e.id) AS rank FROM clusters c JOIN edges e USING (id))
SELECT min(id) FILTER (rank = 1) AS id, max(epoch_us(last_reinforced)) AS last_reinforced_us, len(list_distinct(flatten(list(source_message_ids)))) AS sources FROM m GROUP BY cluster"""


@query("SELECT e.id, greatest(epoch_us(last_reinforced), epoch_us(hi)) AS last_us, least(epoch_us(first_seen), epoch_us(lo)) AS first_us FROM edges e JOIN (SELECT event_id // 10 AS id, max(ts) AS hi, min(ts) AS lo FROM events GROUP BY 1) USING (id)")
def reinforce_fold(spark: SparkSession, d: str) -> DataFrame:
    ops = T.read(spark, d, "events").select(F.floor(F.col("event_id") / 10).cast("long").alias("id"), F.col("ts").alias("at"))
    return mutations.reinforce(T.edges(spark, d), ops).join(ops.select("id").distinct(), "id", "left_semi").select("id", us("last_reinforced", "last_us"), us("first_seen", "first_us"))


def _ops(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return T.read(spark, d, "events").select((F.floor(e / 2)).cast("long").alias("target"), e.alias("seq"), (e + 10_000_000_000).alias("new_id"))


_OPS = """, ops AS (SELECT event_id // 2 AS target, event_id AS seq, event_id + 10000000000 AS new_id FROM events),
judged AS (SELECT ops.*, e.superseded_by AS old, e.predicate, e.importance, e.id IS NULL AS missing, row_number() OVER (PARTITION BY target ORDER BY seq) AS n FROM ops LEFT JOIN edges e ON e.id = target),
good AS (SELECT * FROM judged WHERE NOT missing AND old IS NULL AND n = 1)"""


@query(_OPS + """ SELECT edges.id, coalesce(superseded_by, new_id) AS superseded_by, confidence, edges.importance, source_type FROM edges LEFT JOIN good ON target = edges.id
UNION ALL SELECT new_id, NULL, 1.0, importance, 'user_correction' FROM good""")
def correct_fold(spark: SparkSession, d: str) -> DataFrame:
    edges, none = T.edges(spark, d), F.lit(None)
    ops = _ops(spark, d).select("*", none.cast("long").alias("subject_id"), none.cast("string").alias("predicate"), none.cast("long").alias("object_id"), F.lit("new").alias("object_literal"), none.cast("double").alias("importance"), none.cast("timestamp_ntz").alias("at"))
    return mutations.correct(edges, ops, AS_OF)[0].select("id", "superseded_by", "confidence", "importance", "source_type")


@query(_OPS + """ SELECT edges.id, coalesce(superseded_by, new_id) AS superseded_by, confidence, edges.importance, source_type FROM edges LEFT JOIN good ON target = edges.id
UNION ALL SELECT new_id, NULL, 0.0, 0.0, 'user_deletion' FROM good""")
def soft_delete_fold(spark: SparkSession, d: str) -> DataFrame:
    return mutations.soft_delete(T.edges(spark, d), _ops(spark, d), AS_OF)[0].select("id", "superseded_by", "confidence", "importance", "source_type")


@query(_OPS + " SELECT target, seq, CASE WHEN missing THEN 'not_found' ELSE 'already_superseded' END AS reason FROM judged WHERE missing OR old IS NOT NULL OR n > 1")
def change_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return mutations.soft_delete(T.edges(spark, d), _ops(spark, d), AS_OF)[1]


@query(f""", latest AS (SELECT e.id, max(epoch_us(m.timestamp)) AS t FROM (SELECT id, unnest(source_message_ids) AS mid FROM edges) e JOIN messages m ON m.id = e.mid GROUP BY 1),
facts AS (SELECT e.*, e.superseded_by IS NULL AND e.source_type <> 'user_deletion' AS alive, coalesce(l.t, epoch_us(b.first_seen)) AS until FROM edges e LEFT JOIN edges b ON b.id = e.superseded_by LEFT JOIN latest l ON l.id = b.id),
claims AS (SELECT id AS claim_id, subject_id, predicate, object_id, object_literal, epoch_us(first_seen) AS us FROM edges)
SELECT claim_id, coalesce(NOT bool_or(alive) AND bool_or(superseded_by IS NOT NULL AND us <= until), false) AS stale
FROM claims c LEFT JOIN facts f ON f.subject_id = c.subject_id AND f.predicate = c.predicate AND coalesce(f.object_id = c.object_id, f.object_literal = c.object_literal, false) GROUP BY claim_id""")
def stale_guard(spark: SparkSession, d: str) -> DataFrame:
    edges = T.edges(spark, d)
    claims = edges.select(F.col("id").alias("claim_id"), "subject_id", "predicate", "object_id", "object_literal", F.col("first_seen").alias("at"))
    return mutations.stale_claims(claims, edges, T.messages(spark, d), AS_OF).select("claim_id", "stale")


@query("""SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, external_id ORDER BY id) AS n FROM messages m WHERE id % 2 = 1 AND (external_id IS NULL OR NOT EXISTS
  (SELECT 1 FROM messages s WHERE s.id % 2 = 0 AND s.conversation_id = m.conversation_id AND s.external_id = m.external_id))) WHERE external_id IS NULL OR n = 1""")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    m = T.messages(spark, d)
    return mutations.insert_if_absent(m.filter("id % 2 = 0"), m.filter("id % 2 = 1")).select("id")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown_predicate' WHEN event_id % 7 = 0 THEN 'unknown_object_type' WHEN event_id % 11 = 0 THEN 'empty_subject' WHEN event_id % 13 = 0 THEN 'empty_object' WHEN value / 100 > 1 THEN 'confidence_out_of_range' END AS reject_reason FROM events""")
def triple_validation(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    rows = T.read(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "mood").otherwise("likes").alias("predicate"), F.when(e % 7 == 0, "thing").otherwise("literal").alias("object_type"), F.when(e % 11 == 0, " ").otherwise("a").alias("subject"), F.when(e % 13 == 0, "").otherwise("b").alias("object"), (F.col("value") / 100).alias("confidence"))
    return rows.select("event_id", triples.reject_reason().alias("reject_reason"))


@query()
def idle_trigger_points(spark: SparkSession, d: str) -> DataFrame:
    return A.idle_points(T.messages(spark, d), until=AS_OF).withColumnRenamed("at", "run_at")


def _idle_sql(until: str, start: str | None = None) -> str:
    """A quiet stretch k begins at a and may have an idle run at i; m fallbacks after the last run r come before i."""
    end = f"epoch_us(TIMESTAMP '{until}') // 1000000"
    begin = f"epoch_us(TIMESTAMP '{start}') // 1000000" if start else None
    within = f" WHERE epoch_us(timestamp) // 1000000 BETWEEN {begin or 0} AND {end}" + (f" UNION SELECT {begin}" if begin else "")
    return T.SQL.replace("WITH messages", "WITH RECURSIVE messages", 1) + f""", s AS (SELECT DISTINCT epoch_us(timestamp) // 1000000 AS a FROM messages{within}),
g AS (SELECT a, coalesce(lead(a) OVER (ORDER BY a), {end}) AS b FROM s),
q AS (SELECT a, a + 2100 AS i, row_number() OVER (ORDER BY a) AS k FROM g WHERE b - a >= 2100),
fold AS (
  SELECT 0::BIGINT AS k, (SELECT min(a) FROM s) AS r, (SELECT min(a) FROM s) AS was, 0::BIGINT AS m, false AS fires, 0::BIGINT AS i
  UNION ALL
  SELECT q.k, CASE WHEN x.m = 0 OR f.r + x.m * 72000 <= q.a THEN q.i ELSE f.r + x.m * 72000 END, f.r, x.m, x.m = 0 OR f.r + x.m * 72000 <= q.a, q.i
  FROM fold f JOIN q ON q.k = f.k + 1, LATERAL (SELECT greatest(0, (q.i - f.r - 1) // 72000) AS m) x)
SELECT i AS run_at, 'idle_threshold' AS reason FROM fold WHERE fires
UNION ALL SELECT was + j * 72000, 'max_interval_fallback' FROM fold, unnest(generate_series(1, m)) AS t(j)
UNION ALL SELECT r + j * 72000, 'max_interval_fallback' FROM (SELECT r, ({end} - r - 1) // 72000 AS m FROM fold ORDER BY k DESC LIMIT 1), unnest(generate_series(1, m)) AS t(j)"""


_SQL["idle_trigger_points"] = _idle_sql("2024-02-15")
_WITHIN = "2024-01-08 00:00:30", "2024-01-21 12:34:56"


@query()
def idle_trigger_points_within(spark: SparkSession, d: str) -> DataFrame:
    return A.idle_points(T.messages(spark, d), start=_WITHIN[0], until=_WITHIN[1]).withColumnRenamed("at", "run_at")


_SQL["idle_trigger_points_within"] = _idle_sql(_WITHIN[1], _WITHIN[0])


@query("""SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN '49' || digits || '@s.whatsapp.net' WHEN 1 THEN digits || '@s.whatsapp.net' WHEN 2 THEN digits || '@lid' WHEN 4 THEN c_name END AS identity
FROM (SELECT c_custkey, c_name, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer)""")
def identity_normalisation(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "customer").withColumn("digits", F.regexp_replace("c_name", "[^0-9]", ""))
    k, digits = F.col("c_custkey") % 6, F.col("digits")
    form = F.when(k == 0, F.concat(F.lit("+49 ("), digits, F.lit(")"))).when(k == 1, F.concat(digits, F.lit(":3@c.us"))).when(k == 2, F.concat(F.lit("\t"), digits, F.lit(".1@lid"))).when(k == 3, F.concat(digits, F.lit("@g.us"))).when(k == 4, F.concat(F.col("c_name"), F.lit("  "))).otherwise("ab")
    return c.select(F.col("c_custkey").alias("id"), X.normalise_identity(form).alias("identity"))


@query("""SELECT id, unnest(list_filter([CASE WHEN id % 3 = 0 AND id % 7 = 0 OR id % 3 <> 0 AND id % 5 = 0 THEN 'object_xor' END, CASE WHEN id % 11 = 0 THEN 'sources_set' END], lambda x: x IS NOT NULL)) AS rule FROM edges""")
def edge_audit(spark: SparkSession, d: str) -> DataFrame:
    e = T.edges(spark, d)  # some rows are broken: both objects, none, no sources
    literal = F.when(F.col("object_id").isNotNull() & (F.col("id") % 7 == 0), "both").when(F.col("id") % 5 != 0, F.col("object_literal"))
    return S.edge_violations(e.withColumns({"object_literal": literal, "source_message_ids": F.when(F.col("id") % 11 != 0, F.col("source_message_ids"))}))


# --- more changes, provenance and reports ------------------------------------------------------------------------


@query("SELECT e.id, coalesce(o.importance, e.importance) AS importance FROM edges e LEFT JOIN (SELECT event_id // 3 AS id, arg_max((event_id % 7) / 7, event_id) AS importance FROM events WHERE event_id % 5 <> 0 GROUP BY 1) o USING (id)")
def importance_updates(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    ops = T.read(spark, d, "events").select(F.floor(e / 3).cast("long").alias("id"), e.alias("seq"), F.when(e % 5 != 0, (e % 7) / 7).alias("importance"))
    return mutations.update_importance(T.edges(spark, d), ops).select("id", "importance")


@query("SELECT id, processed OR id % 6 = 0 AS processed FROM messages")
def mark_processed(spark: SparkSession, d: str) -> DataFrame:
    m = T.messages(spark, d)
    return mutations.mark_processed(m, m.filter("id % 6 = 0").select("id")).select("id", "processed")


@query("SELECT vec_id AS message_id, CASE WHEN vec_id % 4 = 0 THEN 2 ELSE len(embedding) END AS width FROM embeddings")
def replace_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = T.embeddings(spark, d)
    new = e.filter("message_id % 4 = 0").select("message_id", F.slice("vector", 1, 2).alias("vector"))
    return mutations.replace_by_key(e, new, "message_id").select("message_id", F.size("vector").cast("long").alias("width"))


@query(""", wanted AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'customer#' || lpad((user_id % 40)::VARCHAR, 9, '0') ELSE 'Topic ' || user_id % 30 END AS name, event_type AS type, event_id AS seq FROM events)
SELECT arg_min(name, seq) AS canonical_name, arg_min(type, seq) AS type FROM wanted WHERE NOT EXISTS (SELECT 1 FROM entities WHERE lower(canonical_name) = lower(name)) GROUP BY lower(name)""")
def new_entities(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    name = F.when(e % 2 == 0, F.concat(F.lit("customer#"), F.lpad((u % 40).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("Topic "), (u % 30).cast("string")))
    wanted = T.read(spark, d, "events").select(name.alias("name"), F.col("event_type").alias("type"), e.alias("seq"))
    return mutations.get_or_create(T.entities(spark, d), wanted).select("canonical_name", "type")


@query("""SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, external_id ORDER BY id) AS n FROM messages m WHERE id % 2 = 1 AND NOT EXISTS
  (SELECT 1 FROM messages s WHERE s.id % 2 = 0 AND s.processed AND s.conversation_id = m.conversation_id AND s.external_id = m.external_id)) WHERE external_id IS NULL OR n = 1""")
def import_resume(spark: SparkSession, d: str) -> DataFrame:
    m = T.messages(spark, d)
    return mutations.to_process(m.filter("id % 2 = 0"), m.filter("id % 2 = 1")).select("id")


@query("""SELECT e.id AS edge_id, coalesce(b.predicate || ': ' || coalesce(b.object_literal, n.canonical_name, ''), 'none') AS superseded_label, e.confidence AS original_confidence
FROM edges e LEFT JOIN edges b ON b.id = e.superseded_by LEFT JOIN entities n ON n.id = b.object_id WHERE e.id = 77""")
def why_believed(spark: SparkSession, d: str) -> DataFrame:
    return R.why(T.edges(spark, d), T.messages(spark, d), T.entities(spark, d), 77).select("edge_id", "superseded_label", "original_confidence")


@query(f""", pool AS (SELECT * FROM decayed WHERE {LIVE} AND subject_id = 7 ORDER BY last_reinforced DESC, id LIMIT 50), top AS (SELECT id, 0.3 * eff + 0.2 * importance AS s FROM pool WHERE NOT ({PRUNE}) ORDER BY s DESC, last_reinforced DESC, id LIMIT 10)
SELECT 7::BIGINT AS id, (SELECT canonical_name FROM entities WHERE id = 7) AS canonical_name, string_agg(id::VARCHAR, ',' ORDER BY s DESC, id) AS facts FROM top""")
def contact_summary(spark: SparkSession, d: str) -> DataFrame:
    stats = A.relationship_stats(T.messages(spark, d), T.edges(spark, d), ME, AS_OF).withColumn("id", F.lit(None).cast("long"))
    got = R.contact_summary(T.entities(spark, d), T.edges(spark, d), stats, 7, AS_OF)
    return got.select(F.col("id").cast("long").alias("id"), "canonical_name", F.array_join(F.transform("facts", lambda x: x["id"].cast("string")), ",").alias("facts"))


@query("SELECT event_type AS model, count(*)::BIGINT AS requests, sum(user_id)::BIGINT AS total_tokens, round(sum(value) * 3, 3) AS extrapolated_cost FROM events GROUP BY 1")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("user_id")
    usage = T.read(spark, d, "events").select(F.col("event_type").alias("model"), (n % 3).alias("path"), n.alias("prompt_tokens"), n.alias("completion_tokens"), n.alias("total_tokens"), F.col("value").alias("cost"), (F.col("value") > 50).alias("price_found"))
    return reports.usage_totals(reports.usage_rollup(usage), 3).select("model", "requests", "total_tokens", F.round("extrapolated_cost", 3).alias("extrapolated_cost"))


@query("""SELECT count(*) FILTER (event_id % 6 = 0) AS created, count(*) FILTER (event_id % 6 = 1) AS reinforced, count(*) FILTER (event_id % 6 = 2) AS corrected, count(*) FILTER (event_id % 6 = 3) AS skipped_no_correction_target,
  count(*) FILTER (event_id % 6 = 4) AS skipped_ambiguous_correction_target, count(*) FILTER (event_id % 6 = 5) AS skipped_stale FROM events""")
def action_counts(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(a) for a in S.ACTIONS])
    return reports.action_counts(T.read(spark, d, "events").select(F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("action")))


@query("SELECT conv_id AS window_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 2 = 0 AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 5)")
def zero_yield_windows(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "conversations")
    w = c.select(F.col("conv_id").alias("window_id")).distinct().withColumn("is_candidate", F.col("window_id") % 2 == 0)
    return reports.zero_yield(w, c.filter("turn = 5").select(F.col("conv_id").alias("window_id"))).select("window_id")


@query("""SELECT CASE WHEN k <= 32 THEN user ELSE '(other)' END AS event_type, sum(n)::BIGINT AS n FROM (SELECT user_id::VARCHAR AS user, count(*) AS n, row_number() OVER (ORDER BY min(event_id), user_id::VARCHAR) AS k FROM events GROUP BY 1) GROUP BY 1""")
def event_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.event_counts(T.read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("event_type")))


@query("SELECT id, min(window_index)::INTEGER AS window_index FROM (SELECT id, (row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp, id) - 1) // 8 AS window_index FROM messages) GROUP BY id")
def history_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.count_windows(T.messages(spark, d), "conversation_id", "timestamp", "id").select("id", "window_index")


@query("""SELECT event_id::VARCHAR AS id, CASE event_id % 10 WHEN 0 THEN 'group' WHEN 1 THEN 'status_broadcast' WHEN 2 THEN 'broadcast_list' WHEN 3 THEN 'newsletter' WHEN 4 THEN 'history_sync'
  WHEN 5 THEN 'edit' WHEN 6 THEN 'unsupported_type' WHEN 7 THEN 'voice_unsupported_live' END AS drop_reason FROM events""")
def live_drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).select("id", live.drop_reason().alias("drop_reason"))


@query("SELECT event_id::VARCHAR AS id, 'after_stop' AS drop_reason FROM events")
def live_drop_reasons_after_stop(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).select("id", live.drop_reason(stopped=True).alias("drop_reason"))


def _live(spark: SparkSession, d: str) -> DataFrame:
    """Events of a connection made of the test table: each reason to drop one has a tenth."""
    e = F.col("event_id")
    k, person = e % 10, F.concat(F.col("user_id").cast("string"), F.lit("@s.whatsapp.net"))
    chat = F.when(k == 0, "1@g.us").when(k == 1, "status@broadcast").when(k == 2, "9@broadcast").when(k == 3, "4@newsletter").when(k == 9, F.concat(F.col("user_id").cast("string"), F.lit(":2@lid"))).otherwise(person)
    none = F.lit(None)
    audio = F.when(k == 7, F.struct(F.lit("u").alias("url")))
    image = F.when((k == 8) & (e % 20 == 8), F.struct(F.col("props").alias("caption"), F.lit("i").alias("url")))
    return T.read(spark, d, "events").select(
        e.cast("string").alias("id"), chat.alias("chat"), chat.alias("sender"), F.when(e % 20 == 9, person).alias("sender_alt"), none.cast("string").alias("recipient_alt"), (k == 8).alias("from_me"), (k == 5).alias("is_edit"), F.col("ts").alias("timestamp"),
        F.when(k == 4, "history_sync").otherwise("message").alias("kind"), F.when(~k.isin(6, 7) & image.isNull(), F.col("props")).alias("conversation"), none.cast("struct<text:string>").alias("extended"), image.alias("image"), none.cast("struct<caption:string,url:string>").alias("video"), audio.alias("audio"),
    )


@query("SELECT event_id::VARCHAR AS external_id, user_id || CASE WHEN event_id % 10 = 9 AND event_id % 20 <> 9 THEN '@lid' ELSE '@s.whatsapp.net' END AS conversation_id, CASE WHEN event_id % 20 = 8 THEN 'image' ELSE 'text' END AS media_type, props AS text, CASE WHEN event_id % 20 = 8 THEN 'i' END AS media_url, CASE WHEN event_id % 10 = 8 THEN 'me@s.whatsapp.net' WHEN event_id % 20 = 9 THEN user_id || '@s.whatsapp.net' ELSE user_id || '@lid' END AS sender_external_id FROM events WHERE event_id % 10 >= 8")
def live_messages(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "hidden string, person string")
    got = live.normalise(live.canonical(_live(spark, d), none, "me@s.whatsapp.net"))
    return got.select("external_id", "conversation_id", "media_type", "text", "media_url", "sender_external_id")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN true WHEN id % 3 = 1 THEN coalesce(v < -0.7, false) ELSE false END AS larger FROM (SELECT event_id AS id, -value / 100 AS v FROM events)")
def transcription_escalation(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    language = F.when(e % 3 == 0, " Arabic ").when(e % 3 == 1, "en")
    logs = F.when(e % 3 != 2, -F.col("value") / 100)
    return T.read(spark, d, "events").select(e.alias("id"), models.escalate(language, logs).alias("larger"))


# --- exports made of the test tables, and read again ---------------------------------------------------------------


@query(""", t AS (SELECT conv_id, turn, min(role) AS role FROM conversations WHERE turn IS NOT NULL AND role IS NOT NULL GROUP BY 1, 2)
SELECT conv_id::VARCHAR AS conversation_id, role AS sender, CASE WHEN turn % 4 = 2 THEN 'image' ELSE 'text' END AS media_type,
  CASE turn % 4 WHEN 0 THEN 'said ' || turn WHEN 1 THEN 'said ' || turn || chr(10) || 'and more' END AS text, epoch_us(TIMESTAMP '2024-03-01 07:00:00') + turn * 60000000 AS at FROM t WHERE turn % 4 <> 3""")
def text_export_messages(spark: SparkSession, d: str) -> DataFrame:
    t = T.read(spark, d, "conversations").filter("turn IS NOT NULL AND role IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    k, stamp = F.col("turn") % 4, F.date_format(F.expr("TIMESTAMP_NTZ '2024-03-01 08:00:00' + make_dt_interval(0, 0, turn, 0)"), "dd/MM/yy, HH:mm:ss")
    body = F.when(k == 2, "image omitted").when(k == 3, "sticker omitted").when(k == 1, F.concat(F.lit("said "), F.col("turn").cast("string"), F.lit("\nand more"))).otherwise(F.concat(F.lit("said "), F.col("turn").cast("string")))
    line = F.concat(F.lit("["), stamp, F.lit("] "), F.col("role"), F.lit(": "), body)
    files = t.groupBy(F.col("conv_id").cast("string").alias("conversation_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("value"))
    got = exports.parse_text_exports(files, "Europe/Berlin")
    return got.select("conversation_id", F.col("sender_external_id").alias("sender"), "media_type", "text", us("timestamp", "at"))


@query("""SELECT user_id::VARCHAR AS conversation_id, CASE event_id % 5 WHEN 1 THEN 'image' WHEN 2 THEN 'voice' ELSE 'text' END AS media_type, CASE WHEN event_id % 5 <> 2 THEN 'café ' || event_id END AS text, event_id * 1000000 AS at FROM events WHERE event_id % 5 < 3""")
def json_thread_messages(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    uri = F.array(F.struct(F.lit("a").alias("uri")))
    none = F.lit(None)
    m = F.struct(
        F.lit("x").alias("sender_name"), (e * 1000).alias("timestamp_ms"), F.when(e % 5 != 3, F.concat(F.lit("caf\u00c3\u00a9 "), e.cast("string"))).alias("content"), (e % 5 == 4).alias("is_unsent"),
        F.when(e % 5 == 1, uri).alias("photos"), none.cast(exports.REF).alias("videos"), F.when(e % 5 == 2, uri).alias("audio_files"), none.cast("struct<link:string,share_text:string>").alias("share"),
    )
    threads = T.read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("thread_path")).agg(F.array_sort(F.collect_list(m), lambda a, b: F.when(a["timestamp_ms"] < b["timestamp_ms"], -1).when(a["timestamp_ms"] > b["timestamp_ms"], 1).otherwise(0)).alias("messages"))
    return exports.parse_threads(threads.withColumn("title", F.lit(""))).select("conversation_id", "media_type", "text", us("timestamp", "at"))


# --- triples -----------------------------------------------------------------------------------------------------

#: For each two events a fact (the even one) and a claim (the odd one) of a subject of their own; the claim's window has three
#: messages, and a correction points at one of them.
_STORED = """, f AS (SELECT event_id AS id, event_id // 2 AS s, 'v' || event_id % 4 AS lit, epoch_us(ts) AS us FROM events WHERE event_id % 2 = 0),
c AS (SELECT event_id AS claim_id, event_id // 2 AS s, 'v' || event_id % 3 AS lit, event_id % 5 < 2 AS corr, [event_id, event_id - 1, event_id // 2] AS ids, least(value / 100, 1) AS conf FROM events WHERE event_id % 2 = 1),
t AS (SELECT claim_id, min(us) AS lo, max(us) AS hi FROM (SELECT claim_id, unnest(ids) AS m FROM c) JOIN (SELECT event_id AS m, epoch_us(ts) AS us FROM events) USING (m) GROUP BY 1),
p AS (SELECT c.claim_id, epoch_us(e.ts) AS us FROM c JOIN events e ON e.event_id = c.ids[claim_id % 3 + 1]),
j AS (SELECT c.*, f.id, f.lit AS old, f.us AS fus, t.lo, t.hi, coalesce(p.us, t.lo) AS pt, CASE WHEN f.id IS NULL THEN CASE WHEN corr THEN 'skipped_no_correction_target' ELSE 'created' END WHEN f.lit = c.lit THEN 'reinforced' WHEN corr THEN 'corrected' ELSE 'created' END AS action
  FROM c JOIN t USING (claim_id) LEFT JOIN p USING (claim_id) LEFT JOIN f USING (s))"""


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, ev = F.col("event_id"), T.read(spark, d, "events")
    s, lit = F.floor(e / 2).cast("string"), lambda n: F.concat(F.lit("v"), (e % n).cast("string"))
    given = {"id": e.cast("string"), "subject_id": s, "predicate": F.lit("likes"), "object_literal": lit(4), "confidence": F.lit(0.5), "importance": F.lit(0.25), "source_type": F.lit("whatsapp_text"), "source_weight": F.lit(1.0), "source_message_ids": F.array(e.cast("string")), "first_seen": F.col("ts"), "last_reinforced": F.col("ts"), "decay_rate": F.lit(S.STABLE), "decay_locked": F.lit(False), "is_correction": F.lit(False)}
    edges = ev.filter(e % 2 == 0).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.EDGES])
    ids = F.array(*[x.cast("long").cast("string") for x in (e, e - 1, F.floor(e / 2))])
    claims = ev.filter(e % 2 == 1).select(e.cast("string").alias("claim_id"), e.alias("window_seq"), F.lit(0).alias("triple_seq"), s.alias("subject_id"), F.lit("likes").alias("predicate"), F.lit(None).cast("string").alias("object_id"), lit(3).alias("object_literal"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), (e % 5 < 2).alias("is_correction"), F.lit(None).cast("string").alias("replaces_object"), F.lit(None).cast("string").alias("replaces_id"), F.lit("voice_transcript").alias("source_type"), ids.alias("source_message_ids"), (e % 3).cast("int").alias("correction_source_index"))
    return triples.store_triples(edges, claims, ev.select(e.cast("string").alias("id"), F.col("ts").alias("timestamp")), AS_OF)


@query(_STORED + " SELECT claim_id::VARCHAR AS claim_id, action FROM j")
def store_triples_actions(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d)[1]


@query(_STORED + """ SELECT f.s::VARCHAR AS subject_id, f.lit AS object_literal, coalesce(j.action = 'corrected', false) AS gone, 0.5 AS confidence,
  CASE WHEN j.action = 'reinforced' THEN least(f.us, CASE WHEN corr THEN j.pt ELSE j.lo END) ELSE f.us END AS first_us, CASE WHEN j.action = 'reinforced' THEN greatest(f.us, CASE WHEN corr THEN j.pt ELSE j.hi END) ELSE f.us END AS last_us FROM f LEFT JOIN j ON j.id = f.id
UNION ALL SELECT s::VARCHAR, lit, false, CASE WHEN action = 'corrected' THEN 1.0 ELSE round(conf * 0.95, 9) END, CASE WHEN action = 'corrected' THEN pt ELSE lo END, CASE WHEN action = 'corrected' THEN pt ELSE hi END FROM j WHERE action IN ('created', 'corrected')""")
def store_triples(spark: SparkSession, d: str) -> DataFrame:
    out, _ = _stored(spark, d)
    return out.select("subject_id", "object_literal", F.col("superseded_by").isNotNull().alias("gone"), F.round("confidence", 9).alias("confidence"), us("first_seen", "first_us"), us("last_reinforced", "last_us"))


_SAID = T.SQL.replace("WITH messages", "WITH RECURSIVE messages", 1) + """, x AS (SELECT event_id AS w, user_id % 40 + 1 AS s, CASE WHEN event_id % 7 = 0 THEN event_id // 2 ELSE event_id END AS m FROM events),
t AS (
  SELECT w, 0 AS seq, s, 'likes' AS p, CASE WHEN w % 3 = 0 THEN 'e:thing ' || (w // 300 + n) % 4 ELSE 'l:v' || (w // 300 + n) % 7 END AS o, n > 0 AS corr,
         CASE (w // 5) % 4 WHEN 2 THEN 'v' || (w // 300) % 7 WHEN 3 THEN 'thing ' || (w // 300) % 4 END AS rep, m FROM (SELECT *, CASE WHEN w % 5 = 0 THEN 3 ELSE 0 END AS n FROM x)
  UNION ALL SELECT w, 1, s, 'works_at', 'l:w' || (w // 500 + (w % 11 = 0)::INTEGER) % 3, w % 11 = 0, NULL, m FROM x),
c AS (SELECT t.*, corr AND g.sender_id = -1 AS own, epoch_us(g.timestamp) AS us, row_number() OVER (PARTITION BY s, p ORDER BY w, seq) AS n FROM t JOIN messages g ON g.id = t.m),
f AS (
  SELECT DISTINCT s, p, 0::BIGINT AS n, []::VARCHAR[] AS live, []::STRUCT(o VARCHAR, u BIGINT)[] AS dead, NULL::VARCHAR AS action, 0::BIGINT AS w, 0 AS seq FROM t
  UNION ALL
  SELECT s, p, n, CASE action WHEN 'created' THEN list_append(live, o) WHEN 'corrected' THEN list_append(list_filter(live, lambda v: v <> hits[1]), o) ELSE live END,
         CASE action WHEN 'corrected' THEN list_append(dead, {'o': hits[1], 'u': us}) ELSE dead END, action, w, seq
  FROM (SELECT *, CASE WHEN own AND len(live) = 0 THEN 'skipped_no_correction_target' WHEN list_contains(live, o) THEN 'reinforced' WHEN own AND len(hits) = 0 THEN 'skipped_no_correction_target'
                       WHEN own AND len(hits) > 1 THEN 'skipped_ambiguous_correction_target' WHEN own THEN 'corrected'
                       WHEN len(list_filter(dead, lambda v: v.o = o AND us <= v.u)) > 0 THEN 'skipped_stale' ELSE 'created' END AS action
        FROM (SELECT f.s, f.p, c.n, f.live, f.dead, c.o, c.own, c.us, c.w, c.seq, list_filter(f.live, lambda v: c.rep IS NULL OR v = 'l:' || c.rep OR v = 'e:' || c.rep) AS hits
              FROM f JOIN c ON c.s = f.s AND c.p = f.p AND c.n = f.n + 1)))"""


def _extracted(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Two triples of each event, as a model would answer: several claims for each person and predicate, some of them corrections
    that name an old value (in another case, as an entity, as blanks) or none, and some said before what was corrected."""
    e = F.col("event_id")
    fifth = F.floor(e / 5)

    def text(head: str, n) -> F.Column:
        return F.concat(F.lit(head), n.cast("string"))

    subject = F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") % 40 + 1).cast("string"), 9, "0"))
    now, new = F.floor(e / 300), F.when(e % 5 == 0, 3).otherwise(0)  # what is liked changes with time; a correction is ahead of it
    likes = {
        "subject": F.upper(subject), "predicate": F.lit("likes"), "object": F.when(e % 3 == 0, text("Thing ", (now + new) % 4)).otherwise(text("v", (now + new) % 7)), "object_type": F.when(e % 3 == 0, "entity").otherwise("literal"),
        "confidence": F.lit(0.5), "is_correction": new > 0, "correction_source_index": F.lit(0),
        "replaces_object": F.when(fifth % 4 == 1, "  ").when(fifth % 4 == 2, text(" V", now % 7)).when(fifth % 4 == 3, text("THING ", now % 4)),
    }
    works = likes | {"subject": subject, "predicate": F.lit("works_at"), "object": text("w", (F.floor(e / 500) + (e % 11 == 0).cast("int")) % 3), "object_type": F.lit("literal"), "is_correction": e % 11 == 0, "replaces_object": F.lit(None).cast("string")}
    output = F.to_json(F.array(*[F.struct(*[v.alias(k) for k, v in t.items()]) for t in (likes, works)]))
    m = F.when(e % 7 == 0, F.floor(e / 2)).otherwise(e)
    said = T.read(spark, d, "events").select(e.alias("window_seq"), F.array(m).alias("window_ids"), F.lit("whatsapp_text").alias("source_type"), output.alias("output"))
    return triples.store_extracted(said, spark.createDataFrame([], S.EDGES), T.entities(spark, d), T.messages(spark, d), ("Self",), AS_OF)


@query()
def extracted_actions(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d)["outcomes"].select("window_seq", "triple_seq", "action")


_SQL["extracted_actions"] = _SAID + " SELECT w AS window_seq, seq AS triple_seq, action FROM f WHERE n > 0"


@query()
def extracted_live_facts(spark: SparkSession, d: str) -> DataFrame:
    got = _extracted(spark, d)
    names = got["entities"].select(F.col("id").alias("object_id"), F.concat(F.lit("e:"), F.lower("canonical_name")).alias("named"))
    rows = got["edges"].filter(R.live()).join(names, "object_id", "left")
    return rows.select(F.col("subject_id").cast("long").alias("subject_id"), "predicate", F.coalesce("named", F.concat(F.lit("l:"), F.col("object_literal"))).alias("object"))


_SQL["extracted_live_facts"] = _SAID + " SELECT s AS subject_id, p AS predicate, unnest(live) AS object FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY s, p ORDER BY n DESC) = 1)"


_NAMES = """, x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'customer#' || lpad((user_id % 40)::VARCHAR, 9, '0') WHEN 1 THEN ' me ' ELSE 'Someone ' || user_id % 30 END AS subject, 'Thing ' || user_id % 20 AS object, event_id % 3 = 0 AS is_entity, CASE WHEN event_id % 5 = 0 THEN 'pet_of' ELSE 'likes' END AS predicate FROM events),
uses AS (SELECT event_id, 0 AS place, subject AS name, 'person' AS type FROM x WHERE event_id % 4 <> 1 UNION ALL SELECT event_id, 1, object, CASE WHEN predicate = 'pet_of' THEN 'person' ELSE 'object' END FROM x WHERE is_entity)"""


def _resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, u = F.col("event_id"), F.col("user_id").cast("long")
    subject = F.when(e % 4 == 0, F.concat(F.lit("customer#"), F.lpad((u % 40).cast("string"), 9, "0"))).when(e % 4 == 1, " me ").otherwise(F.concat(F.lit("Someone "), (u % 30).cast("string")))
    rows = T.read(spark, d, "events").select(e.alias("window_seq"), F.lit(0).alias("triple_seq"), subject.alias("subject"), F.when(e % 5 == 0, "pet_of").otherwise("likes").alias("predicate"), F.concat(F.lit("Thing "), (u % 20).cast("string")).alias("object"), F.when(e % 3 == 0, "entity").otherwise("literal").alias("object_type"))
    return triples.resolve_names(rows, T.entities(spark, d), ("Self", "Me"))


@query(_NAMES + " SELECT arg_min(name, event_id * 2 + place) AS canonical_name, arg_min(type, event_id * 2 + place) AS type FROM uses WHERE NOT EXISTS (SELECT 1 FROM entities WHERE lower(canonical_name) = lower(name)) GROUP BY lower(name)")
def resolved_new_entities(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)[1].select("canonical_name", "type")


@query(_NAMES + """ SELECT event_id, CASE WHEN event_id % 4 = 1 THEN '-1' ELSE (SELECT min(id)::VARCHAR FROM entities WHERE lower(canonical_name) = lower(subject)) END AS known_subject, CASE WHEN NOT is_entity THEN object END AS object_literal, is_entity AS has_object_id FROM x""")
def resolved_triples(spark: SparkSession, d: str) -> DataFrame:
    rows, new = _resolved(spark, d)
    known = rows.join(new.select(F.col("id").alias("subject_id"), F.lit(True).alias("is_new")), "subject_id", "left")
    return known.select(F.col("window_seq").alias("event_id"), F.when(F.col("is_new").isNull(), F.col("subject_id")).alias("known_subject"), "object_literal", F.col("object_id").isNotNull().alias("has_object_id"))


@query(""", m AS (SELECT id, sender_id FROM messages), w AS (SELECT event_id AS id, [event_id, event_id - 1, event_id + 1000000000] AS ids, event_id % 5 - 1 AS i FROM events)
SELECT w.id, coalesce(i >= 0 AND i < 3 AND m.sender_id = -1, false) AS is_correction FROM w LEFT JOIN m ON m.id = CASE WHEN i BETWEEN 0 AND 2 THEN ids[i + 1] END""")
def trusted_corrections(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    rows = T.read(spark, d, "events").select(e.alias("id"), F.array(e, e - 1, e + 1_000_000_000).alias("window_ids"), (e % 5 - 1).cast("int").alias("correction_source_index"), F.lit(True).alias("is_correction"))
    return triples.trusted_corrections(rows, T.messages(spark, d), T.entities(spark, d)).select("id", "is_correction")


@query("SELECT event_id AS id, 'a' AS subject, value AS confidence, event_id % 3 = 2 AS bad FROM events WHERE event_id % 3 <> 1")
def parsed_model_output(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    good = F.concat(F.lit('```json\n[{"subject":"a","predicate":"likes","object":"b","object_type":"literal","confidence":'), F.col("value").cast("string"), F.lit("}]\n```"))
    rows = T.read(spark, d, "events").select(e.alias("id"), F.when(e % 3 == 0, good).when(e % 3 == 1, "[]").otherwise("none found").alias("output"), "value")
    got = triples.parse_output(rows)
    bad = F.col("parse_error").isNotNull()
    return got.select("id", F.lit("a").alias("subject"), F.when(bad, F.col("value")).otherwise(F.col("confidence")).alias("confidence"), bad.alias("bad"))


# --- scalar functions and small lookups -----------------------------------------------------------------------------


@query("SELECT event_id AS id, event_id % 3 = 0 AS candidate FROM events")
def triage_answers(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    answer = F.when(e % 3 == 0, "  candidate: yes").when(e % 3 == 1, "NOISE candidate")
    return T.read(spark, d, "events").select(e.alias("id"), models.is_candidate(answer).alias("candidate"))


@query("""SELECT event_id AS id, coalesce(round(value / CASE event_id % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.4 END, 6), 0) AS original, CASE WHEN event_id % 2 = 0 AND ts < TIMESTAMP '2024-01-15' THEN 'event_past' WHEN event_id % 2 = 0 THEN 'event_future' ELSE 'likes' END AS tense,
  CASE WHEN event_id % 2 = 0 THEN 0.0001 ELSE 0.004621 END AS rate, CASE WHEN event_id % 2 = 0 THEN 'person' ELSE 'object' END AS type, chr(8230) || right(event_id::VARCHAR, 4) AS tail,
  'id ' || CASE WHEN event_id + 10000000 >= 10000000 THEN chr(8230) || right((event_id + 10000000)::VARCHAR, 4) END AS redacted, event_id || '.ogg' AS file, CASE WHEN event_id % 2 = 0 THEN 'Me' ELSE 'You' END AS speaker, round(least(3 * pow(2, event_id % 9), 300) * (0.8 + 0.4 * value / 100), 6) AS wait
FROM events""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    e, even = F.col("event_id"), F.col("event_id") % 2 == 0
    weight = F.when(e % 3 == 0, 0.95).when(e % 3 == 1, 0.4).otherwise(0.0)
    text = e.cast("string")
    return T.read(spark, d, "events").select(
        e.alias("id"), F.round(X.reconstructed_confidence(F.col("value"), weight), 6).alias("original"), X.event_tense(F.when(even, "event_future").otherwise("likes"), F.col("ts"), "2024-01-15 00:00:00").alias("tense"),
        X.default_decay_rate(F.when(even, "pet_of").otherwise("no such predicate")).alias("rate"), X.object_entity_type(F.when(even, "family_member_of").otherwise("likes")).alias("type"), X.keep_last_four(text).alias("tail"),
        X.cut_digits(F.concat(F.lit("id "), (e + 10_000_000).cast("string"))).alias("redacted"), X.part_name(F.concat(text, F.lit(".opus"))).alias("file"), X.speaker(even, F.lit("Me"), F.lit("You")).alias("speaker"),
        F.round(X.backoff(e % 9, 3, 300, F.col("value") / 100), 6).alias("wait"),
    )


@query("""SELECT event_id AS id, '{"i":' || event_id % 8 || ',"ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","speaker":"s","text":"' || replace(props, '"', '\\"') || '"}' AS line FROM events""")
def prompt_lines(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return T.read(spark, d, "events").select(e.alias("id"), X.prompt_line(e % 8, F.col("ts"), F.lit("s"), F.col("props")).alias("line"))


@query("SELECT id, contains(object_literal, '%') AS percent, contains(lower(object_literal), 'k') AS letter FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'K% off' ELSE object_literal END AS object_literal FROM edges) WHERE object_literal IS NOT NULL")
def literal_search(spark: SparkSession, d: str) -> DataFrame:
    e = T.edges(spark, d).withColumn("object_literal", F.when(F.col("id") % 2 == 0, "K% off").otherwise(F.col("object_literal"))).filter("object_literal IS NOT NULL")
    return e.select("id", R.contains(F.col("object_literal"), "%").alias("percent"), R.contains(F.col("object_literal"), "K").alias("letter"))


@query("SELECT id FROM messages WHERE conversation_id = (SELECT min(conversation_id) FROM messages) AND external_id = (SELECT min(external_id) FROM messages WHERE conversation_id = (SELECT min(conversation_id) FROM messages)) ORDER BY id LIMIT 1")
def message_by_external_id(spark: SparkSession, d: str) -> DataFrame:
    m = T.messages(spark, d)
    c = m.agg(F.min("conversation_id")).first()[0]
    x = m.filter(F.col("conversation_id") == c).agg(F.min("external_id")).first()[0]
    return R.message_by_external_id(m, c, x).select("id")


@query("SELECT vec_id AS message_id, len(embedding) AS width FROM embeddings WHERE vec_id = 3")
def embedding_by_message(spark: SparkSession, d: str) -> DataFrame:
    return R.embedding_of(T.embeddings(spark, d), 3).select("message_id", F.size("vector").cast("long").alias("width"))


@query("SELECT e.id FROM edges e WHERE e.id IN (SELECT user_id FROM events)")
def edges_by_id_table(spark: SparkSession, d: str) -> DataFrame:
    return R.by_id_table(T.edges(spark, d), T.read(spark, d, "events").select("user_id")).select("id")


@query("SELECT id FROM messages WHERE id IN (2, 4, 400)")
def messages_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.by_ids(T.messages(spark, d), [2, 4, 400]).select("id")


@query(_RECENCY.replace(", recent", _KINDS + ", recent", 1) + " SELECT contact_id, last FROM recent WHERE contact_id = (SELECT min(contact_id) FROM recent)")
def relationship_of_contact(spark: SparkSession, d: str) -> DataFrame:
    stats = A.relationship_stats(T.messages(spark, d), T.edges(spark, d), ME, AS_OF)
    return R.relationship(stats, stats.agg(F.min("contact_id")).first()[0]).select("contact_id", "last")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def status_tally(spark: SparkSession, d: str) -> DataFrame:
    return reports.tally(T.read(spark, d, "events").select(F.col("event_type").alias("status")))


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN round(-value, 6) ELSE round((-value - 1) / 2, 6) END AS segments, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN round(value, 6) ELSE round((value + 0.25) / 2, 6) END AS mean, CASE event_id % 3 WHEN 1 THEN value WHEN 2 THEN least(value, 0.25) END AS least FROM events")
def transcript_metrics(spark: SparkSession, d: str) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    segments = F.when(e % 3 == 1, F.array(F.struct((-v).alias("avg_logprob")))).when(e % 3 == 2, F.array(F.struct((-v).alias("avg_logprob")), F.struct(F.lit(-1.0).alias("avg_logprob")))).otherwise(F.array().cast("array<struct<avg_logprob:double>>"))
    words = F.when(e % 3 == 1, F.array(F.struct(v.alias("probability")))).when(e % 3 == 2, F.array(F.struct(v.alias("probability")), F.struct(F.lit(0.25).alias("probability")))).otherwise(F.array().cast("array<struct<probability:double>>"))
    rows = T.read(spark, d, "events").select(e.alias("id"), models.segment_mean(segments).alias("s"), models.word_metrics(words).alias("w"))
    return rows.select("id", F.round("s", 6).alias("segments"), F.round("w.mean", 6).alias("mean"), F.col("w.least").alias("least"))


# --- rows put in, changed and taken out; recovery; totals ---------------------------------------------------------


@query("SELECT id, CASE WHEN id >= 20000000000 THEN epoch_us(TIMESTAMP '2024-02-15') ELSE epoch_us(first_seen) END AS first_us FROM (SELECT id, first_seen FROM edges UNION ALL SELECT id + 20000000000, first_seen FROM edges WHERE predicate = 'likes')")
def inserted_edges(spark: SparkSession, d: str) -> DataFrame:
    e, none = T.edges(spark, d), F.lit(None).cast("timestamp_ntz")
    new = e.filter("predicate = 'likes'").withColumns({"id": F.col("id") + 20_000_000_000, "first_seen": none, "last_reinforced": none})
    return mutations.store_memory(e, new, AS_OF).select("id", us("first_seen", "first_us"))


@query("SELECT subject_id AS contact_id, max(n)::DOUBLE AS frequency FROM (SELECT subject_id, 1 AS n FROM edges UNION ALL SELECT subject_id, 2 FROM edges WHERE predicate = 'likes') GROUP BY 1")
def upsert_stats(spark: SparkSession, d: str) -> DataFrame:
    e = T.edges(spark, d)
    old = e.select(F.col("subject_id").alias("contact_id"), F.lit(1.0).alias("frequency")).distinct()
    return mutations.replace_by_key(old, e.filter("predicate = 'likes'").select(F.col("subject_id").alias("contact_id"), F.lit(2.0).alias("frequency")).distinct(), "contact_id")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'Renamed' ELSE canonical_name END AS canonical_name FROM entities WHERE id % 7 <> 0")
def updated_entities(spark: SparkSession, d: str) -> DataFrame:
    e = T.entities(spark, d)
    new = mutations.update_rows(e, e.filter("id % 3 = 0").select("id", F.lit("Renamed").alias("canonical_name")), "canonical_name")
    return mutations.delete_rows(new, e.filter("id % 7 = 0").select("id")).select("id", "canonical_name")


_LOST = f" FROM messages m LEFT JOIN entities s ON s.id = m.sender_id WHERE NOT processed AND {_TEXT}"


@query("SELECT count(*) FILTER (s.id IS NULL) AS errors, count(*) FILTER (s.id IS NOT NULL) AS recovered" + _LOST.replace("entities s", "(SELECT id FROM entities WHERE id % 2 <> 0) s"))
def recovery_errors(spark: SparkSession, d: str) -> DataFrame:
    return windows.recovery_errors(T.messages(spark, d), T.entities(spark, d).filter("id % 2 <> 0"))


@query("SELECT m.id, conversation_id" + _LOST + " AND s.id IS NOT NULL")
def recovery_windows(spark: SparkSession, d: str) -> DataFrame:
    got = windows.recovery_windows(T.messages(spark, d), T.entities(spark, d))
    return got.select("id", "conversation_id")


@query("SELECT count(*) FILTER (error IS NULL) AS conversations, sum(messages)::BIGINT AS messages, sum(windows)::BIGINT AS windows, sum(triples)::BIGINT AS triples, count(*) FILTER (error IS NOT NULL) AS failed FROM (SELECT conversation_id, count(*) AS messages, count(*) // 8 AS windows, max(id) AS triples, CASE WHEN conversation_id % 3 = 0 THEN 'x' END AS error FROM messages GROUP BY 1)")
def import_totals(spark: SparkSession, d: str) -> DataFrame:
    c = F.count("*")
    return reports.import_totals(T.messages(spark, d).groupBy("conversation_id").agg(c.alias("messages"), F.floor(c / 8).alias("windows"), F.max("id").alias("triples")).withColumn("error", F.when(F.col("conversation_id") % 3 == 0, "x")))


@query("SELECT event_type, least(count(*), 12) AS n FROM events GROUP BY 1")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = T.read(spark, d, "events").select(F.col("event_id").alias("id"), "event_type")
    return reports.stratified_sample(rows, "event_type", 60, 1).groupBy("event_type").agg(F.count("*").alias("n"))  # five types


@query("SELECT window_id, ids, 'text' AS kind FROM (SELECT conversation_id AS window_id, count(*) AS ids FROM messages WHERE media_type = 'text' GROUP BY 1)")
def merged_runs(spark: SparkSession, d: str) -> DataFrame:
    n = T.messages(spark, d).filter("media_type = 'text'").groupBy(F.col("conversation_id").alias("window_id")).agg(F.count("*").alias("ids"))
    return reports.merged_runs([n.filter("window_id % 2 = 0"), n.filter("window_id % 2 <> 0").withColumn("extra", F.lit(1))]).select("window_id", "ids", F.lit("text").alias("kind"))
