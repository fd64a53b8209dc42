"""Filters, lookups, and retrieval of facts: candidate pools, ranking, search, provenance, contact summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.functions import expr as X


@dataclass(frozen=True)
class Filters:
    """None leaves a filter out; an empty collection matches nothing."""

    subject: object = None
    source_types: tuple[str, ...] | None = None
    since: str | None = None


@dataclass(frozen=True)
class Weights:
    similarity: float = 0.5
    confidence: float = 0.3
    importance: float = 0.2

    def effective(self) -> Weights:
        """The defaults, if all weights are 0."""
        return self if self.similarity or self.confidence or self.importance else Weights()


CONFIDENCE_FLOOR, IMPORTANCE_FLOOR = 0.15, 0.1


def live(prefix: str = "") -> Column:
    """Not superseded and no tombstone."""
    return F.col(f"{prefix}superseded_by").isNull() & (F.col(f"{prefix}source_type") != S.USER_DELETION)


def tombstone(source_type: Column) -> Column:
    return source_type == S.USER_DELETION


def retrievable(f: Filters = Filters()) -> Column:  # noqa: B008
    c = live()
    if f.subject is not None:
        c &= F.col("subject_id") == F.lit(f.subject)
    if f.source_types is not None:
        c &= F.col("source_type").isin(*f.source_types) if f.source_types else F.lit(False)
    if f.since is not None:
        c &= X.micros(F.col("first_seen")) >= X.as_of_micros(f.since)
    return c


def prunable(as_of: str, confidence_floor: float = 0, importance_floor: float = 0) -> Column:
    """Faded or unimportant: below a floor (at it, a fact stays).  Locked facts and corrections never are.  A floor of 0 or
    less means the default."""
    low = confidence_floor if confidence_floor > 0 else CONFIDENCE_FLOOR
    least = importance_floor if importance_floor > 0 else IMPORTANCE_FLOOR
    return ~F.col("decay_locked") & ~F.col("is_correction") & ((X.effective_confidence(as_of) < low) | (F.col("importance") < least))


def contains(text: Column, query: str) -> Column:
    """Whether text has query in it, in either case; no character of query is special; null text doesn't."""
    return F.coalesce(F.contains(F.lower(text), F.lower(F.lit(query))), F.lit(False))


# --- lookups -----------------------------------------------------------------------------------------------------


def by_ids(df: DataFrame, ids: list, key: str = "id") -> DataFrame:
    return df.filter(F.col(key).isin(*ids)) if ids else df.limit(0)


def by_id_table(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def entity_by_name(entities: DataFrame, name: str) -> DataFrame:
    return entities.filter(F.lower("canonical_name") == F.lower(F.lit(name))).orderBy("id").limit(1)


def self_entity(entities: DataFrame) -> DataFrame:
    return entities.filter("is_self").orderBy("id").limit(1)


def facts_about(edges: DataFrame, subject, predicate: str, only_live: bool = False) -> DataFrame:
    rows = edges.filter((F.col("subject_id") == F.lit(subject)) & (F.col("predicate") == predicate))
    return rows.filter(live()) if only_live else rows


def meet_by_object(facts: DataFrame, wanted: DataFrame, how: str = "inner") -> DataFrame:
    """facts beside the wanted rows (subject_id, predicate, w_id, w_lit, and others) of the same object, as `expr.same_object` has it.

    By entity where both have one, else by literal: two joins by object, so the facts of a subject and predicate never meet all that
    is asked of these.  No fact meets a wanted row in both.
    """
    key = [F.col("f.subject_id") == F.col("w.subject_id"), F.col("f.predicate") == F.col("w.predicate")]
    f, w = facts.alias("f"), wanted.alias("w")
    rest = [F.col(f"w.{c}") for c in wanted.columns if c not in ("subject_id", "predicate")]
    ids = f.join(w, [*key, F.col("f.object_id") == F.col("w.w_id")], how).select("f.*", *rest)
    literals = f.join(w, [*key, F.col("f.object_literal") == F.col("w.w_lit"), F.col("f.object_id").isNull() | F.col("w.w_id").isNull()], how).select("f.*", *rest)
    return ids.unionByName(literals)


def _wanted(wanted: DataFrame, *more: str) -> DataFrame:
    return wanted.select("subject_id", "predicate", F.col("object_id").alias("w_id"), F.col("object_literal").alias("w_lit"), *more)


def matching_live(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (subject_id, predicate, object_id, object_literal) the first live edge with that object.

    Of equal facts only the first goes on to meet what is wanted, so neither facts nor wanted rows of a busy key multiply."""
    order = F.struct(X.micros(F.col("first_seen")).alias("us"), F.col("id"))
    by = ["subject_id", "predicate", "object_id", "object_literal"]
    first = edges.filter(live()).groupBy(*by).agg(F.min_by(F.struct(*edges.columns), order).alias("e"), F.min(order).alias("o"))
    w = _wanted(wanted).distinct()
    hits = meet_by_object(first, w).groupBy("subject_id", "predicate", "w_id", "w_lit").agg(F.min_by("e", "o").alias("e"))
    return hits.select("e.*")


def superseded_matches(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The superseded edges with a wanted object, once for each wanted row."""
    return meet_by_object(edges.filter(F.col("superseded_by").isNotNull()), _wanted(wanted)).select(*edges.columns)


def conversation_range(messages: DataFrame, conversation, since: str) -> DataFrame:
    return messages.filter((F.col("conversation_id") == F.lit(conversation)) & (X.micros(F.col("timestamp")) >= X.as_of_micros(since))).orderBy("timestamp", "id")


def message_by_external_id(messages: DataFrame, conversation, external: str) -> DataFrame:
    return messages.filter((F.col("conversation_id") == F.lit(conversation)) & (F.col("external_id") == external)).orderBy("id").limit(1)


def embedding_of(embeddings: DataFrame, message) -> DataFrame:
    return embeddings.filter(F.col("message_id") == F.lit(message)).limit(1)


def history(edges: DataFrame, entity) -> DataFrame:
    """All that was ever known about an entity, as subject or object, tombstones and superseded facts too."""
    return edges.filter((F.col("subject_id") == F.lit(entity)) | (F.col("object_id") == F.lit(entity))).orderBy("first_seen", "id")


# --- similarity, pool, ranking ---------------------------------------------------------------------------------


def best_similarity(edges: DataFrame, embeddings: DataFrame, query: list[float]) -> DataFrame:
    """id and the best cosine of each edge's source messages to the query; null without an embedded source.

    The vectors are compared once a message, and only numbers travel to the edges.
    """
    near = embeddings.select("message_id", X.cosine(F.col("vector"), F.array(*[F.lit(float(v)) for v in query])).alias("similarity"))
    sources = edges.select("id", F.explode_outer("source_message_ids").alias("message_id"))
    return sources.join(near, "message_id", "left").groupBy("id").agg(F.max("similarity").alias("similarity"))


def pool_size(top: int) -> tuple[int, int]:
    """How many facts to return (6 by default, 50 at most) and how many to rank (5 times that, 200 at most)."""
    n = 6 if top <= 0 else min(top, 50)
    return n, min(5 * n, 200)


def candidate_pool(edges: DataFrame, size: int, f: Filters = Filters(), embeddings: DataFrame | None = None, query: list[float] | None = None) -> DataFrame:  # noqa: B008
    """The facts to rank: with a query the most similar, else the most recently reinforced; ties by recency and id."""
    rows = edges.filter(retrievable(f))
    recent = X.micros(F.col("last_reinforced")).desc()
    if query is None:
        return rows.withColumn("similarity", F.lit(0.0)).orderBy(recent, "id").limit(size)
    pool = rows.join(best_similarity(rows, embeddings, query), "id").orderBy(F.col("similarity").desc_nulls_last(), recent, "id").limit(size)
    return pool.withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def relevant_context(edges: DataFrame, as_of: str, top: int = 0, f: Filters = Filters(), weights: Weights = Weights(), include_pruned: bool = False, embeddings: DataFrame | None = None, query: list[float] | None = None) -> DataFrame:  # noqa: B008
    """The facts to tell a model: pool, prune, score, cut.  The pool comes first, so pruned facts use up places in it."""
    n, size = pool_size(top)
    w = weights.effective()
    pool = candidate_pool(edges, size, f, embeddings, query)
    kept = pool if include_pruned else pool.filter(~prunable(as_of))
    score = w.similarity * F.col("similarity") + w.confidence * X.effective_confidence(as_of) + w.importance * F.col("importance")
    order = [F.col("similarity").desc_nulls_last(), X.micros(F.col("last_reinforced")).desc(), F.col("id")]  # of the pool
    return kept.withColumn("score", score).orderBy(F.desc("score"), *order).limit(n)


def keyword_matches(edges: DataFrame, entities: DataFrame, query: str) -> DataFrame:
    """Live facts with the query in subject name, predicate or literal.  Names are searched before edges meet them."""
    named = entities.filter(contains(F.col("canonical_name"), query)).select(F.col("id").alias("subject_id"), F.lit(True).alias("__named"))
    rows = edges.filter(live()).join(named, "subject_id", "left")
    hits = rows.filter(F.col("__named") | contains(F.col("predicate"), query) | contains(F.col("object_literal"), query)).drop("__named")
    return hits.join(entities.select(F.col("id").alias("subject_id"), F.col("canonical_name").alias("subject_name")), "subject_id")


def keyword_search(edges: DataFrame, entities: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """keyword_matches, the most important and newest first."""
    return keyword_matches(edges, entities, query).orderBy(F.desc("importance"), X.micros(F.col("first_seen")).desc(), "id").limit(limit)


def semantic_search(embeddings: DataFrame, messages: DataFrame, query: list[float], k: int = 10, distinct: bool = False) -> DataFrame:
    """The messages nearest to the query.  A message with two vectors is found twice, unless distinct.

    Only ids and distances meet the ids of messages; one top-k follows, and its k rows meet the messages.
    """
    near = embeddings.select("message_id", (1 - X.cosine(F.col("vector"), F.array(*[F.lit(float(v)) for v in query]))).alias("distance"))
    if distinct:
        near = near.groupBy("message_id").agg(F.min("distance").alias("distance"))
    order = [F.col("distance").asc_nulls_last(), F.col("message_id")]
    known = near.join(messages.select(F.col("id").alias("message_id")).distinct(), "message_id", "left_semi")
    return known.orderBy(*order).limit(k).join(messages.withColumnRenamed("id", "message_id"), "message_id").orderBy(*order)


# --- provenance and contacts -----------------------------------------------------------------------------------


def sources_of(edges: DataFrame, messages: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each source message of each edge: edge_id, day, sender (name, '' if unknown), media_type."""
    at = edges.select(F.col("id").alias("edge_id"), F.explode("source_message_ids").alias("id"))
    names = entities.select(F.col("id").alias("sender_id"), "canonical_name")
    return at.join(messages, "id").join(names, "sender_id", "left").select("edge_id", F.to_date("timestamp").alias("day"), F.coalesce("canonical_name", F.lit("")).alias("sender"), "media_type")


def seen_days(sources: DataFrame) -> DataFrame:
    return sources.groupBy("edge_id").agg(F.array_sort(F.collect_set("day")).alias("days"))


def tally(sources: DataFrame, by: str) -> DataFrame:
    """Counts of each edge by sender or media type, the largest first, ties by name."""
    counts = sources.groupBy("edge_id", by).agg(F.count("*").alias("n"))
    return counts.groupBy("edge_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(by).alias("name"), F.col("n")))), lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))).alias(f"{by}s"))


def why(edges: DataFrame, messages: DataFrame, entities: DataFrame, edge_id) -> DataFrame:
    """Why a fact is believed: when it was seen, who said it and how, what replaced it, and what the model had said."""
    one = edges.filter(F.col("id") == F.lit(edge_id))
    src = sources_of(one, messages, entities)
    nxt = edges.select(F.col("id").alias("superseded_by"), F.col("predicate").alias("p2"), F.col("object_id").alias("o2"), F.col("object_literal").alias("l2"))
    names = entities.select(F.col("id").alias("o2"), F.col("canonical_name").alias("n2"))
    label = F.coalesce(X.edge_label(F.col("p2"), F.coalesce("l2", "n2", F.lit(""))), F.lit("none"))
    out = one.join(nxt, "superseded_by", "left").join(names, "o2", "left").withColumn("superseded_label", label).withColumnRenamed("id", "edge_id")
    for part in (seen_days(src), tally(src, "sender"), tally(src, "media_type")):
        out = out.join(part, "edge_id", "left")
    return out.withColumn("original_confidence", X.reconstructed_confidence(F.col("confidence"), F.col("source_weight")) if "source_weight" in edges.columns else F.col("confidence"))


def contact_summary(entities: DataFrame, edges: DataFrame, stats: DataFrame, contact, as_of: str, top: int = 10) -> DataFrame:
    """A person with their statistics, if any, and their top facts.  Any other entity is an error."""
    person = entities.filter(F.col("id") == F.lit(contact))
    person = person.withColumn("type", F.when(F.col("type") == "person", F.col("type")).otherwise(F.raise_error(F.lit("not a person"))))
    facts = relevant_context(edges, as_of, top, Filters(subject=contact)).select("id", "predicate", "score")
    listed = facts.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "predicate"))).alias("facts")).withColumn("id", F.lit(contact))
    return person.join(stats.drop("id").withColumnRenamed("contact_id", "id"), "id", "left").join(listed, "id", "left")


def relationship(stats: DataFrame, contact) -> DataFrame:
    found = stats.filter(F.col("contact_id") == F.lit(contact))
    if found.isEmpty():
        raise LookupError("relationship statistics have not been computed for this contact")
    return found


def style_profile(*_):
    raise NotImplementedError("style profiles are not implemented")
