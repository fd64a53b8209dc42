"""Duplicate facts: alike objects of one subject and predicate, seen within a day of each other, chained into clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import expr as X
from factloom.operators.mutations import merge_duplicates
from factloom.operators.retrieval import live
from factloom.store import keep

WITHIN_SECONDS, THRESHOLD = 24 * 3600, 0.85


def mergeable(edges: DataFrame) -> DataFrame:
    return edges.filter(live() & ~F.col("decay_locked") & ~F.col("is_correction"))


def _rare_first(rows: DataFrame) -> DataFrame:
    """rows with `w` (distinct words) as array `keys`: the words with which a row has to meet all that are alike.

    Two sets with a Dice of t share at least t / (2 - t) of the words of either, so one of the first words of each, in one order
    for all, is common to both.  The rarest come first.  Sets without words meet by the empty word.
    """
    words = rows.select("id", F.explode("w").alias("word"))
    ranked = words.join(words.groupBy("word").agg(F.count("*").alias("n")), "word")
    order = ranked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("ranked"))
    return rows.join(order, "id", "left").withColumn("ranked", F.coalesce("ranked", F.array(F.lit(""))))


def duplicate_pairs(edges: DataFrame, within: int = WITHIN_SECONDS, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b), a before b, of duplicates.

    Facts meet by subject, predicate, time bucket (a fact lies in its own and the next ones) and object: the entity, or the rarest
    words of the literal.  A subject with very many different facts of a day is never compared all with all.
    """
    width = within * 1_000_000
    rows = mergeable(edges).select("id", "subject_id", "predicate", "object_id", X.micros(F.col("first_seen")).alias("us"), X.tokens(F.col("object_literal")).alias("w"))
    bucket = F.floor(F.col("us") / width) if width else F.col("us")
    near = (F.col("p.id") < F.col("q.id")) & (F.abs(F.col("p.us") - F.col("q.us")) <= width)

    def meet(one: DataFrame, *keys: str) -> DataFrame:
        p = one.withColumn("bucket", F.explode(F.array(bucket, bucket + 1, bucket - 1))).alias("p")
        q = one.withColumn("bucket", bucket).alias("q")
        return p.join(q, [*[F.col(f"p.{k}") == F.col(f"q.{k}") for k in ("subject_id", "predicate", "bucket", *keys)], near])

    entities = meet(rows.filter("object_id IS NOT NULL").drop("w"), "object_id").select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    literals = _rare_first(rows.filter("object_id IS NULL AND w IS NOT NULL").drop("object_id"))
    some = F.size("w") - F.ceil(F.size("w") * threshold / (2 - threshold) - 1e-9) + 1
    keyed = literals.withColumn("key", F.explode(F.slice("ranked", F.lit(1), F.greatest(some, F.lit(1)).cast("int")))).drop("ranked")
    alike = X.dice(F.col("p.w"), F.col("q.w")) >= threshold
    return entities.union(meet(keyed, "key").filter(alike).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct())


def duplicate_links(edges: DataFrame, within: int = WITHIN_SECONDS, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) that lead wherever `duplicate_pairs` lead, as many as facts, about, instead of all pairs.

    Facts of one subject, predicate and object (the entity, or the set of words) in one time bucket are all duplicates: each is
    linked with the bucket's first.  Two buckets side by side are linked from the one's last to the other's first, if these are near
    enough; no other fact of theirs is nearer.  Of different sets of words only one representative for each bucket meets others.
    """
    width = within * 1_000_000
    us = X.micros(F.col("first_seen"))
    words = F.array_sort(X.tokens(F.col("object_literal")))
    rows = mergeable(edges).filter("object_id IS NOT NULL OR object_literal IS NOT NULL")
    rows = rows.select("id", "subject_id", "predicate", F.col("object_id").cast("string").alias("object"), F.when(F.col("object_id").isNull(), words).alias("w"), us.alias("us"), (F.floor(us / width) if width else us).alias("bucket"))
    key = ["subject_id", "predicate", "object", "w"]
    rows = keep(rows.withColumn("k", F.xxhash64(*key)))  # a short name for the join back; the groups themselves go by the key
    ends = rows.groupBy(*key, "k", "bucket").agg(F.min(F.struct("us", "id")).alias("first"), F.max(F.struct("us", "id")).alias("last"), F.count("*").alias("n"))
    ends = keep(ends)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in key]
    star = rows.alias("r").join(ends.filter("n > 1").alias("e"), [F.col("r.k") == F.col("e.k"), F.col("r.bucket") == F.col("e.bucket"), *same]).filter((F.col("r.id") != F.col("e.first.id"))).select(F.col("e.first.id").alias("a"), F.col("r.id").alias("b"))
    w = Window.partitionBy(*key).orderBy("bucket")
    chain = ends.withColumn("before", F.lag("last").over(w)).filter(F.col("first.us") - F.col("before.us") <= width).select(F.col("before.id").alias("a"), F.col("first.id").alias("b"))
    # representatives of different sets of words
    sets = ends.filter("w IS NOT NULL").select(F.xxhash64("k", "bucket").alias("id"), "subject_id", "predicate", "bucket", "w", "first", "last")
    ranked = _rare_first(sets.select("id", "w").distinct())
    some = F.greatest(F.size("w") - F.ceil(F.size("w") * threshold / (2 - threshold) - 1e-9) + 1, F.lit(1)).cast("int")
    keyed = sets.join(ranked.select("id", "ranked"), "id").withColumn("key", F.explode(F.slice("ranked", F.lit(1), some))).drop("ranked")
    p = keyed.withColumn("to", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1))).alias("p")
    near = (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.id") < F.col("q.id")) | (F.col("p.bucket") < F.col("q.bucket")) & (F.col("q.first.us") - F.col("p.last.us") <= width)
    met = p.join(keyed.alias("q"), [F.col("p.subject_id") == F.col("q.subject_id"), F.col("p.predicate") == F.col("q.predicate"), F.col("p.to") == F.col("q.bucket"), F.col("p.key") == F.col("q.key"), near])
    different = met.filter((F.col("p.w") != F.col("q.w")) & (X.dice(F.col("p.w"), F.col("q.w")) >= threshold))
    across = different.select(F.when(F.col("p.bucket") == F.col("q.bucket"), F.col("p.first.id")).otherwise(F.col("p.last.id")).alias("a"), F.col("q.first.id").alias("b")).distinct()
    return star.union(chain).union(across)


def clusters(pairs: DataFrame) -> DataFrame:
    """id and cluster (the smallest id that pairs lead to).  Labels spread along pairs and are followed to their own labels,
    until none changes."""
    both = keep(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("cluster")))
    while True:
        near = both.join(labels.toDF("b", "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        spread = labels.join(near, "id").select("id", F.least("cluster", "c").alias("cluster"))
        new = keep(spread.join(labels.toDF("cluster", "up"), "cluster", "left").select("id", F.least("cluster", F.coalesce("up", "cluster")).alias("cluster")))
        if new.join(labels.toDF("id", "old"), "id").filter("cluster <> old").isEmpty():
            return new
        labels = new


def links_with_new(old: DataFrame, new: DataFrame, within: int = WITHIN_SECONDS, threshold: float = THRESHOLD) -> DataFrame:
    """Links that lead wherever pairs with a new fact lead.  Of the old facts only those of a new one's subject, predicate and time
    bucket, or of the buckets beside it, take part."""
    width = within * 1_000_000
    us = X.micros(F.col("first_seen"))
    bucket = F.floor(us / width) if width else us
    touched = mergeable(new).select("subject_id", "predicate", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__bucket")).distinct()
    near = old.withColumn("__bucket", bucket).join(touched, ["subject_id", "predicate", "__bucket"], "left_semi").select(*old.columns)
    return duplicate_links(near.unionByName(new.select(*old.columns)), within, threshold)


def merged_clusters(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The clusters (id, cluster) that labels and more links (a, b) make.  Links join whole clusters: only clusters that a link
    touches are looked at, not their members' links."""
    of = labels.select("id", "cluster")

    def whose(rows: DataFrame, end: str) -> DataFrame:
        return rows.join(of.toDF(end, f"{end}_in"), end, "left").withColumn(end, F.coalesce(f"{end}_in", end)).drop(f"{end}_in")

    ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    fresh = ends.join(of, "id", "left_anti").select("id", F.col("id").alias("cluster"))
    between = keep(whose(whose(links.select("a", "b"), "a"), "b").filter("a <> b").select("a", "b").distinct())
    moved = clusters(between).toDF("cluster", "__to")
    return of.unionByName(fresh).join(moved, "cluster", "left").select("id", F.coalesce("__to", "cluster").alias("cluster"))


def dedup_new(labels: DataFrame, old: DataFrame, new: DataFrame, within: int = WITHIN_SECONDS, threshold: float = THRESHOLD) -> DataFrame:
    """The clusters of old and new facts together, from the old facts' clusters (id, cluster; as `clusters` gives them for the old
    facts) without comparing old facts with each other again.  Facts that are no longer mergeable need a full pass."""
    return keep(merged_clusters(labels, links_with_new(old, new, within, threshold)))


def cluster_members(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """cluster, id and rank; the first seen ranks first and survives.  pairs: all duplicates, or links that lead as far."""
    rows = clusters(pairs).join(edges.select("id", "first_seen"), "id")
    return keep(rows.select("cluster", "id", F.row_number().over(Window.partitionBy("cluster").orderBy("first_seen", "id")).alias("rank")))


def dedup_pass(edges: DataFrame, within: int = WITHIN_SECONDS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges after merging, conflicts, and how many facts were merged away."""
    members = cluster_members(edges, duplicate_links(edges, within, threshold))
    out, bad = merge_duplicates(edges, members)
    merged = members.join(bad, "cluster", "left_anti").filter("rank > 1").agg(F.count("*").alias("merged"))
    return out, bad, merged
