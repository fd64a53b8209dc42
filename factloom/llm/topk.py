"""Exact top-k inner products by term-at-a-time accumulation.

Each query block is a bounded broadcast (QUERY_BLOCK rows), and its result lies in the shared folder before the next one is read;
candidates stay where they are.  For each chunk of
candidates the components become postings (term -> candidates with a non-zero weight); each term's sparse query
weights scatter its postings into a dense score array.  Every task keeps its best k a query; a merge picks the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint_dir, cut, table, tidy

K, EVERY, SCALE = 20, 20, 64
#: Queries in one broadcast, and the rows and columns of one score array.
QUERY_BLOCK, QUERIES, CHUNK = 16_384, 512, 4_096
#: The largest long; scores beyond it are held as it (or its negative), and fail if they are among the results.
MOST = (1 << 63) - 1


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id and floor(scale * x) for every component; rows whose id or vector is null, or holds null or non-finite, go.

    A component whose floor(scale * x) is no long fails.
    """

    def whole(v):
        size = F.abs(v.cast("double"))
        over = (size >= float(1 << 63) / scale) & (size < float("inf"))
        return F.when(over, F.raise_error(F.lit("a scaled component does not fit a long")).cast("long")).otherwise(F.floor(v.cast("double") * scale))

    x = F.transform(F.col(vector_col), whole)
    ok = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ok).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of the given width; shorter ones end in zeros."""
    ends = col.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat, n = col.flatten().to_numpy(zero_copy_only=False), np.diff(ends)
    out = np.zeros((len(n), width), np.int64)
    at = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], n)
    row, keep = np.repeat(np.arange(len(n)), n), at < width
    out[row[keep], at[keep]] = flat[keep]
    return out


def scatter_scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all rows, a term at a time: only non-zero query weights meet non-zero postings.

    Rows whose product may pass a long are multiplied as Python's integers; what does pass it is MOST or -MOST.
    """
    large_q, large_c = (np.abs(x.astype(np.float64)).max(1, initial=0) for x in (queries, candidates))
    width = max(1, queries.shape[1])
    most = large_q.max(initial=0) * large_c.max(initial=0) * width
    kind = np.int32 if most < 1 << 31 else np.int64
    scores = np.zeros((len(queries), len(candidates)), kind)
    for term in range(queries.shape[1]):
        rows, posting = np.flatnonzero(queries[:, term]), np.flatnonzero(candidates[:, term])
        if not len(rows) or not len(posting):
            continue
        weights, values = queries[rows, term].astype(kind), candidates[posting, term].astype(kind)
        if len(posting) * 2 > len(candidates):  # a long posting is added as a whole line; its zeros add nothing
            values, posting = candidates[:, term].astype(kind), slice(None)
        if len(rows) == len(queries) and isinstance(posting, slice):
            scores += weights[:, None] * values
        elif isinstance(posting, slice):
            scores[rows] += weights[:, None] * values
        else:
            scores[np.ix_(rows, posting)] += weights[:, None] * values
    if most >= 1 << 62:
        for i in np.flatnonzero(large_q * large_c.max() * width >= 1 << 62):
            q = queries[i].tolist()
            for j in np.flatnonzero(large_q[i] * large_c * width >= 1 << 62):
                scores[i, j] = max(-MOST, min(MOST, sum(a * b for a, b in zip(q, candidates[j].tolist(), strict=True))))
    return scores


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k columns of each row by falling score, then rising id."""
    if score.shape[1] > 4 * k:
        edge = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        above = score > edge
        n = above.sum(axis=1)
        at = score == edge
        if (n + at.sum(axis=1) == k).all():
            pick = np.argsort(~(above | at), axis=1, kind="stable")[:, :k]
        else:  # of those at the edge, only the smallest ids
            pick = np.empty((len(score), k), np.int64)
            for i in range(len(score)):
                tied = np.flatnonzero(at[i])
                need = k - n[i]
                if len(tied) > need:
                    tied = tied[np.argsort(ids[i, tied] if ids.ndim == 2 else ids[tied], kind="stable")[:need]]
                pick[i] = np.concatenate([np.flatnonzero(above[i]), tied])
        score, ids = np.take_along_axis(score, pick, 1), np.take_along_axis(ids, pick, 1) if ids.ndim == 2 else ids[pick]
    elif ids.ndim == 1:
        ids = np.broadcast_to(ids, score.shape)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _search(queries: np.ndarray, k: int):
    """A mapInArrow function: each partition's best k of its rows for every query, as (q, id, score)."""

    def run(batches):
        best = [(np.zeros((min(QUERIES, len(queries) - q), 0), np.int64), np.zeros((min(QUERIES, len(queries) - q), 0), np.int64)) for q in range(0, len(queries), QUERIES)]
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                ids, x = part.column("id").to_numpy(), _matrix(part.column("x"), queries.shape[1])
                for i, q in enumerate(range(0, len(queries), QUERIES)):
                    s, own = _best(scatter_scores(queries[q : q + QUERIES], x), ids, k)
                    best[i] = _best(np.concatenate([best[i][0], s.astype(np.int64)], 1), np.concatenate([best[i][1], own], 1), k)
        for i, (s, ids) in enumerate(best):
            q = np.repeat(np.arange(len(s)) + i * QUERIES, s.shape[1])
            yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int32()), "id": pa.array(ids.ravel(), pa.int64()), "score": pa.array(s.ravel(), pa.int64())})

    return run


def query_blocks(asked: DataFrame) -> Iterator[tuple[bool, pa.Table]]:
    """Whether there is one block only, and the rows of asked in blocks of QUERY_BLOCK at most.

    The driver holds one block: they are numbered once, and more than one lie in the shared folder.
    """
    spark = asked.sparkSession
    kept = cut(asked.withColumn("__i", F.monotonically_increasing_id()))
    counts = kept.groupBy(F.shiftright("__i", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a line a partition
    total = sum(r.n for r in counts)
    if total <= QUERY_BLOCK:
        yield True, kept.drop("__i").toArrow()
        return
    before = zip([r.p for r in counts], np.cumsum([0, *(r.n for r in counts)])[:-1].tolist(), strict=True)
    offsets = spark.createDataFrame(list(before), "p long, before long")
    folder = f"{checkpoint_dir(spark)}/queries-{uuid.uuid4().hex}"
    placed = kept.withColumn("p", F.shiftright("__i", 33)).join(offsets, "p")
    block = F.floor((F.col("before") + F.col("__i") - F.shiftleft("p", 33)) / QUERY_BLOCK).cast("int")
    placed.select(*asked.columns, block.alias("__block")).write.partitionBy("__block").parquet(folder)
    for b in range(-(-total // QUERY_BLOCK)):
        yield False, spark.read.schema(asked.schema).parquet(f"{folder}/__block={b}").toArrow()


def top_k(df: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows with the highest integer inner product for each query row.

    is_query: a condition on the column `id`.  Returns query_id, rank (from 1), vec_id, score.  Ties go to the smaller
    id.  A query doesn't find its own row, but does find other rows that share its id.  Each query row has its own
    ranks, also if ids repeat.  Vectors may differ in length: missing components count as 0.  Rows with a null id, or
    a null, NaN or infinite component take no part; an empty vector scores 0.  Fewer than k candidates give fewer rows.
    Scores are exact sums of longs; a component of 2^63 / SCALE or more fails, and so does a result whose score isn't
    between -2^63 + 1 and 2^63 - 1, both excluded.
    """
    spark = df.sparkSession
    rows = quantised(df, id_col, vector_col)
    found = f"{checkpoint_dir(spark)}/topk-{uuid.uuid4().hex}"
    single, out = True, spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for single, block in query_blocks(rows.filter(is_query).groupBy("id", "x").count()):
        if not block.num_rows:
            break
        block = block.combine_chunks()
        x = block.column("x").combine_chunks()
        width = max(1, int(np.diff(x.offsets.to_numpy(zero_copy_only=False)).max(initial=0)))
        queries = _matrix(x, width)
        own = np.array([min(MOST, sum(v * v for v in q)) for q in queries.tolist()], np.int64)
        scored = rows.mapInArrow(tidy(_search(queries, k + 1)), "q int, id long, score long")
        asked_rows = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(queries)), pa.int32()), "query_id": block.column("id"), "own": pa.array(own, pa.int64()), "n": block.column("count")}))
        w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        best = scored.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).join(F.broadcast(asked_rows), "q")
        # one row with the query's id and its product with itself is the query's own
        mine = (F.col("id") == F.col("query_id")) & (F.col("score") == F.col("own"))
        self_at = F.min(F.when(mine, F.col("r"))).over(Window.partitionBy("q"))
        best = best.withColumn("self_at", F.coalesce(self_at, F.lit(k + 2))).filter((F.col("r") != F.col("self_at")) & (F.col("r") - (F.col("r") > F.col("self_at")).cast("int") <= k))
        fits = F.when(F.abs("score") < MOST, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit a long")).cast("long"))
        best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        out = best.select("query_id", (F.col("r") - (F.col("r") > F.col("self_at")).cast("int")).cast("int").alias("rank"), F.col("id").alias("vec_id"), fits.alias("score"))
        if not single:
            out.write.mode("append").parquet(found)
    return out if single else spark.read.schema(out.schema).parquet(found)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; vectors with a null or non-finite component take no part, ties go to smaller ids; see `top_k`."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.rid, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
