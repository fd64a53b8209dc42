"""Changes as functions from tables and operations to new tables.  Of operations that exclude each other the first wins;
the others come back as conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.functions import expr as X
from factloom.operators.retrieval import live, meet_by_object


def insert_edges(edges: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """New facts, seen and reinforced now where they don't say when."""
    now = F.lit(as_of).cast(edges.schema["first_seen"].dataType)
    return edges.unionByName(new.withColumns({c: F.coalesce(c, now) for c in ("first_seen", "last_reinforced")}), allowMissingColumns=True)


def store_memory(edges: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """insert_edges for predicates of the vocabulary; another one is an error."""
    ok = F.when(F.col("predicate").isin(*S.PREDICATES), F.col("predicate")).otherwise(F.raise_error(F.concat(F.lit("unknown predicate: "), F.coalesce("predicate", F.lit("null")))).cast("string"))
    return insert_edges(edges, new.withColumn("predicate", ok), as_of)


def insert_if_absent(messages: DataFrame, new: DataFrame, order: str = "id") -> DataFrame:
    """The new messages that aren't stored: one for each (conversation, external id), the first; without an external id all."""
    key = ["conversation_id", "external_id"]
    keyed = new.filter(F.col("external_id").isNotNull())
    fresh = keyed.join(messages.filter(F.col("external_id").isNotNull()).select(*key).distinct(), key, "left_anti")
    one = fresh.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("__n = 1").drop("__n")
    return new.filter(F.col("external_id").isNull()).unionByName(one)


def to_process(messages: DataFrame, new: DataFrame, order: str = "id") -> DataFrame:
    """What an import goes on with: messages not stored before, and those stored but not processed."""
    key = ["conversation_id", "external_id"]
    done = messages.filter(F.col("processed") & F.col("external_id").isNotNull()).select(*key).distinct()
    rows = new.join(done, key, "left_anti")
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("__n", F.when(F.col("external_id").isNull(), 1).otherwise(F.row_number().over(w))).filter("__n = 1").drop("__n")


def reinforce(edges: DataFrame, ops: DataFrame) -> DataFrame:
    """ops: id, at.  The latest and the earliest time count; nothing else changes, in whatever order ops come."""
    seen = ops.groupBy("id").agg(F.max("at").alias("__hi"), F.min("at").alias("__lo"))
    return edges.join(seen, "id", "left").withColumns({"last_reinforced": F.greatest("last_reinforced", "__hi"), "first_seen": F.least("first_seen", "__lo")}).select(*edges.columns)


def update_importance(edges: DataFrame, ops: DataFrame) -> DataFrame:
    """ops: id, seq, importance (null: no change).  The last one wins."""
    last = ops.filter(F.col("importance").isNotNull()).groupBy("id").agg(F.max_by("importance", "seq").alias("__new"))
    return edges.join(last, "id", "left").withColumn("importance", F.coalesce("__new", "importance")).select(*edges.columns)


def _targets(edges: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operations (target, seq, new_id) that may go ahead, with the edge they replace, and conflicts with a reason."""
    first = F.row_number().over(Window.partitionBy("target").orderBy("seq"))
    joined = ops.withColumn("__n", first).join(edges.select(*[F.col(c).alias(f"old_{c}") for c in edges.columns]), F.col("target") == F.col("old_id"), "left")
    why = F.when(F.col("old_id").isNull(), "not_found").when(F.col("old_superseded_by").isNotNull() | (F.col("__n") > 1), "already_superseded")
    judged = joined.withColumn("reason", why)
    return judged.filter("reason IS NULL").drop("__n", "reason"), judged.filter("reason IS NOT NULL").select("target", "seq", "reason")


def _superseded(edges: DataFrame, by: DataFrame) -> DataFrame:
    """edges, with superseded_by set from by (id, __by)."""
    return edges.join(by, "id", "left").withColumn("superseded_by", F.coalesce("superseded_by", F.col("__by").cast(edges.schema["superseded_by"].dataType))).select(*edges.columns)


def correct(edges: DataFrame, ops: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """ops: target, seq, new_id, and the new subject_id, predicate, object_id, object_literal, importance, at (null: as
    before, now; the object is always the new one).  Returns the edges and the conflicts."""
    good, bad = _targets(edges, ops)
    at = F.coalesce("at", F.lit(as_of).cast(edges.schema["first_seen"].dataType))
    predicate = F.coalesce("predicate", "old_predicate")
    given = {
        "id": F.col("new_id"), "subject_id": F.coalesce("subject_id", "old_subject_id"), "predicate": predicate, "object_id": F.col("object_id"), "object_literal": F.col("object_literal"),
        "confidence": F.lit(1.0), "importance": F.coalesce("importance", "old_importance"), "source_type": F.lit(S.USER_CORRECTION), "source_weight": F.lit(1.0),
        "first_seen": at, "last_reinforced": at, "decay_rate": X.default_decay_rate(predicate), "decay_locked": F.lit(True), "superseded_by": F.lit(None), "is_correction": F.lit(True),
        "source_message_ids": F.array(),
    }
    new = good.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in edges.schema])
    return _superseded(edges, good.select(F.col("target").alias("id"), F.col("new_id").alias("__by"))).unionByName(new), bad


def soft_delete(edges: DataFrame, ops: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """ops: target, seq, new_id.  A tombstone of the same subject, predicate and object replaces each target."""
    good, bad = _targets(edges, ops)
    now = F.lit(as_of)
    given = {
        "id": F.col("new_id"), "confidence": F.lit(0.0), "importance": F.lit(0.0), "source_type": F.lit(S.USER_DELETION), "source_weight": F.lit(1.0), "source_message_ids": F.array(),
        "first_seen": now, "last_reinforced": now, "decay_locked": F.lit(False), "superseded_by": F.lit(None), "is_correction": F.lit(False),
    }
    new = good.select(*[given.get(f.name, F.col(f"old_{f.name}")).cast(f.dataType).alias(f.name) for f in edges.schema])
    return _superseded(edges, good.select(F.col("target").alias("id"), F.col("new_id").alias("__by"))).unionByName(new), bad


def merge_duplicates(edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members: cluster, id, rank (the survivor has the lowest).  The survivor gets the sources of all in order, each once,
    and the latest reinforcement; the others are superseded by it.  A cluster with a member that is missing, superseded,
    locked, a correction or a tombstone changes nothing and is a conflict."""
    own = edges.select("id", "source_message_ids", "last_reinforced", "superseded_by", "decay_locked", "is_correction", "source_type")
    rows = members.join(own.withColumn("__found", F.lit(True)), "id", "left")
    bad = ~F.coalesce("__found", F.lit(False)) | F.col("superseded_by").isNotNull() | F.coalesce("decay_locked", F.lit(False)) | F.coalesce("is_correction", F.lit(False)) | F.coalesce(F.col("source_type") == S.USER_DELETION, F.lit(False))
    clusters = rows.groupBy("cluster").agg(
        F.bool_or(bad).alias("bad"),
        F.min_by("id", "rank").alias("survivor"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_message_ids"))), lambda x: x["source_message_ids"]))).alias("__ids"),
        F.max("last_reinforced").alias("__last"),
    )
    good = clusters.filter(~F.col("bad"))
    survivors = good.select(F.col("survivor").alias("id"), "__ids", "__last")
    by = members.join(good.select("cluster", "survivor"), "cluster").filter("id <> survivor").select("id", F.col("survivor").alias("__by"))
    out = edges.join(survivors, "id", "left").withColumns({"source_message_ids": F.coalesce("__ids", "source_message_ids"), "last_reinforced": F.coalesce("__last", "last_reinforced")}).select(*edges.columns)
    return _superseded(out, by), clusters.filter("bad").select("cluster", F.lit("conflict").alias("reason"))


def get_or_create(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: name, type, seq.  The entities to add: one for each name (case aside) that isn't there, with the first type."""
    have = entities.select(F.lower("canonical_name").alias("k")).distinct()
    return wanted.withColumn("k", F.lower("name")).join(have, "k", "left_anti").groupBy("k").agg(F.min_by("name", "seq").alias("canonical_name"), F.min_by("type", "seq").alias("type")).drop("k")


def resolve_senders(senders: DataFrame, entities: DataFrame, self_ids: DataFrame) -> DataFrame:
    """senders: platform, sender.  Adds name: the self entity's for one's own identities; a sender who bears that name
    without being oneself is an error."""
    me = entities.filter("is_self").select("canonical_name").limit(1).scalar()
    own = self_ids.select("platform", F.col("identity").alias("norm")).distinct().withColumn("own", F.lit(True))
    rows = senders.withColumn("norm", F.coalesce(X.normalise_identity(F.col("sender")), F.trim("sender"))).join(own, ["platform", "norm"], "left")
    clash = F.lower("sender") == F.lower(me)
    return rows.withColumn("name", F.when(F.col("own"), me).when(clash, F.raise_error(F.lit("a sender has the name of the self entity")).cast("string")).otherwise(F.col("sender"))).drop("norm", "own")


def bootstrap_problems(entities: DataFrame, name: str, others: tuple[str, ...] = ()) -> list[str]:
    """Why a self entity of this name can't be made: all reasons at once.  others: aliases and identities, which no one else may
    bear either."""
    taken = [n.strip().lower() for n in (name, *others) if n.strip()]
    lower = F.lower("canonical_name")
    row = entities.agg(
        F.count_if(F.col("is_self")).alias("selves"),
        F.count_if(F.col("is_self") & (lower != name.strip().lower())).alias("renamed"),
        F.array_sort(F.collect_set(F.when(~F.col("is_self") & lower.isin(*taken), lower))).alias("named"),
    ).first()
    return (
        ["there is more than one self entity"] * (row.selves > 1)
        + ["the self entity has another name"] * (row.renamed > 0)
        + [f"another entity has this name: {n}" for n in row.named]
        + ["the name is empty"] * (not name.strip())
    )


def bootstrap_self(entities: DataFrame, name: str, others: tuple[str, ...], as_of: str) -> DataFrame:
    """The entities with exactly one self entity of this name, made if there is none.  Nothing is changed if there are problems:
    all of them are raised at once.  Ids are strings; the same name gives the same id."""
    if problems := bootstrap_problems(entities, name, others):
        raise ValueError("; ".join(problems))
    if not entities.filter("is_self").isEmpty():
        return entities
    given = {"id": X.uuid5(F.lit(f"entity:{name.strip().lower()}")), "type": F.lit("person"), "canonical_name": F.lit(name.strip()), "is_self": F.lit(True), "created_at": F.lit(as_of), "updated_at": F.lit(as_of)}
    one = entities.sparkSession.range(1).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in entities.schema])
    return entities.unionByName(one)


def replace_by_key(table: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """table without the keys of new, and new: replaces embeddings by message, statistics by contact."""
    return table.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def mark_processed(messages: DataFrame, ids: DataFrame) -> DataFrame:
    return messages.join(ids.select("id").distinct().withColumn("__p", F.lit(True)), "id", "left").withColumn("processed", F.col("processed") | F.coalesce("__p", F.lit(False))).select(*messages.columns)


def update_rows(table: DataFrame, new: DataFrame, *columns: str) -> DataFrame:
    """The named columns of rows whose id is in new."""
    changed = new.select("id", *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    return table.join(changed, "id", "left").withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).select(*table.columns)


def delete_rows(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id").distinct(), "id", "left_anti")


def stale_claims(claims: DataFrame, edges: DataFrame, messages: DataFrame, as_of: str) -> DataFrame:
    """claims: claim_id, subject_id, predicate, object_id, object_literal, at.  Adds stale: an equal fact was superseded,
    by one whose latest source (else first sight) isn't before the claim, and no equal fact is live.

    Of equal facts one row goes on to meet claims: whether one is live, and when the last of them was superseded."""
    now = X.as_of_micros(as_of)
    sources = edges.select(F.col("id").alias("by"), F.explode("source_message_ids").alias("id"))
    latest = sources.join(messages.select("id", F.least(X.micros(F.col("timestamp")), now).alias("t")), "id").groupBy("by").agg(F.max("t").alias("latest"))
    by = edges.select(F.col("id").alias("by"), F.least(X.micros(F.col("first_seen")), now).alias("seen")).join(latest, "by", "left").select("by", F.coalesce("latest", "seen").alias("until"))
    facts = edges.join(by, F.col("superseded_by") == F.col("by"), "left")
    facts = facts.groupBy("subject_id", "predicate", "object_id", "object_literal").agg(F.bool_or(live()).alias("alive"), F.max(F.when(F.col("superseded_by").isNotNull(), F.col("until"))).alias("late"))
    asked = claims.select("claim_id", "subject_id", "predicate", F.col("object_id").alias("w_id"), F.col("object_literal").alias("w_lit"), F.least(X.micros(F.col("at")), now).alias("us"))
    hits = meet_by_object(facts, asked)
    judged = hits.groupBy("claim_id").agg(F.bool_or("alive").alias("__alive"), F.bool_or(F.coalesce(F.col("us") <= F.col("late"), F.lit(False))).alias("__late"))
    return claims.join(judged, "claim_id", "left").withColumn("stale", F.coalesce(~F.col("__alive") & F.col("__late"), F.lit(False))).drop("__alive", "__late")
