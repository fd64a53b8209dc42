"""Mixing sources to target weights by hash thresholds, without sorting documents.

Words are summed by source and hash bucket.  The budget of each source falls into one bucket; only that bucket's rows
are summed again by the next bits of their hash, until one hash value is left.  The thresholds then filter the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import WORD, cut, table

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
#: Bits of the hash, and bits that one level of the histogram resolves.
BITS, LEVEL = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of an md5 over id and text."""
    md5 = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(md5, 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> dict[str | None, float]:
    """Each source's share of all words by weight; what a source can't fill goes to the others, by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = sum(sizes.values()), {}, list(order)
    while open_:
        all_weights = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] > max_repeat * sizes[s] * all_weights]
        if not full:
            return out | {s: left * weight[s] / all_weights for s in open_}
        out |= {s: float(max_repeat * sizes[s]) for s in full}
        left -= sum(max_repeat * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def measured(df: DataFrame) -> DataFrame:
    """df and its rows' size (words, 0 for null) and hash h."""
    return df.withColumns({"size": word_count(F.col("text")), "h": row_hash(F.col("doc_id"), F.col("text"))})


def thresholds(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One line a source from rows of source, size and h, which are read several times: s, source_size, target, whole
    (copies of each document) and threshold (documents with a smaller hash get one more)."""
    spark = rows.sparkSession
    sizes = {r.source: int(r.n) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    target = targets(sizes, weights, max_repeat)
    whole = {s: math.floor(target[s] / n) if n else 0 for s, n in sizes.items()}
    extra = {s: target[s] - whole[s] * n for s, n in sizes.items()}

    # prefix: the bits of the boundary bucket; done: words of the buckets before it
    bound = {s: (0, 0) for s in sizes}
    cross: dict[str | None, tuple[int, int, int]] = {}
    for level in range(BITS // LEVEL):
        left = {s: b for s, b in bound.items() if s not in cross and extra[s] > 0}
        if not left:
            break
        shift = BITS - LEVEL * (level + 1)
        plan = spark.createDataFrame([(s, p, d, extra[s]) for s, (p, d) in left.items()], "source string, prefix long, done long, extra double").withColumnRenamed("source", "s")
        inside = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + LEVEL) == F.col("prefix")))
        histogram = inside.groupBy("s", "done", "extra", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        w = Window.partitionBy("s").orderBy("bucket")
        summed = histogram.withColumn("upto", F.col("done") + F.sum("n").over(w))
        crossing = summed.filter("upto > extra").groupBy("s").agg(F.min(F.struct("bucket", "n", "upto", "low", "high")).alias("x"))
        for s, x in crossing.collect():
            bound[s] = (x.bucket, x.upto - x.n)
            if x.low == x.high:
                cross[s] = (x.low, x.upto - x.n, x.n)
    threshold = []
    for s in sizes:
        h, done, n = cross.get(s, (0, 0, 0))
        threshold.append((s, sizes[s], target[s], whole[s], h + (done + n - extra[s] < extra[s] - done)))
    return spark.createDataFrame(threshold, "s string, source_size long, target double, whole int, threshold long")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (measured) with source_size, target and copies."""
    out = rows.join(plan, F.col("source").cast("string").eqNullSafe(F.col("s")))
    return out.withColumn("copies", F.col("whole") + (F.col("h") < F.col("threshold")).cast("int")).drop("s", "whole", "threshold")


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """How often each document enters a mix in which sources share all words by weight.

    Returns doc_id, source, size (words, 0 for null), source_size, target (words of its source), copies, taken
    (size * copies).  Every document of a source enters floor(target / source_size) times; of the rest of the budget,
    those with the smallest hashes enter once more.  The document at the threshold enters if that brings the source
    nearer to its target.  Null is a source of its own, last in order.  Rows that share id and text share a hash and
    are taken or left together.  A source without words has target 0 and copies 0.  Other columns are ignored.
    The driver sees one line a source.
    """
    rows = cut(measured(df.select("doc_id", "text", F.col("source").cast("string").alias("source"))).drop("text"))
    out = with_copies(rows, thresholds(rows, weights, max_repeat))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mix itself: df's columns, each row as often as `mix` says.

    Rows of equal id, text and source are taken equally often; a null source is a source of its own, and a text without
    words (null, empty) fills no target: it comes as often as its hash and its source's thresholds say.
    """
    small = cut(measured(df.select("doc_id", "text", F.col("source").cast("string").alias("source"))).drop("text"))
    plan = thresholds(small, weights, max_repeat)
    rows = with_copies(df.withColumn("h", row_hash(F.col("doc_id"), F.col("text"))), plan).filter("copies > 0")
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).select(*df.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a null source is a source, a null text has no words; rows wholly alike are taken alike; see `mix`."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS ss FROM docs GROUP BY source),
s1 AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, sum(ss) OVER ()::BIGINT AS t FROM s0),
s2 AS (SELECT *, row_number() OVER o AS rn,
              (sum(3 * ss) OVER o - 3 * ss)::BIGINT AS capped, (sum(w) OVER () - sum(w) OVER o + w)::BIGINT AS wleft
       FROM s1 WINDOW o AS (ORDER BY ss::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
k AS (SELECT rn AS k, t - capped AS rem, wleft FROM s2 WHERE (t - capped) * w <= 3 * ss * wleft ORDER BY rn LIMIT 1),
s3 AS (SELECT source, ss, CASE WHEN rn < k THEN (3 * ss)::DOUBLE ELSE (rem * w)::DOUBLE / k.wleft::DOUBLE END AS target FROM s2, k),
s4 AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss)::BIGINT ELSE 0 END AS whole FROM s3),
s5 AS (SELECT *, target - whole * ss AS extra FROM s4),
d AS (SELECT doc_id, size, ss, target, whole, extra,
             sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS own
      FROM docs d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, ss AS source_size, target,
       (size * (whole + CASE WHEN upto <= extra OR upto - extra < extra - (upto - own) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d
"""
