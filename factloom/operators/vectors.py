"""Nearest vectors for many queries at once: exactly, in blocks, and through an index of cells with residual codes.

Blocks of queries meet blocks of vectors in numpy; every task keeps its best few for each query, and these merge.  No pair of a
query and a vector is ever a row, but for the best of a task.  Similarity is the cosine, rounded to 12 digits, so that equal
vectors tie wherever they lie.  A vector without length, with a null, or as long as no query has no cosine and is found by none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import expr as X
from factloom.operators import retrieval as R
from factloom.store import checkpoint_folder, keep

#: Queries that all tasks hold at once, and rows scored at once.
BLOCK, ROWS = 4096, 2048
DIGITS = 12


def _unit(col: pa.Array | pa.ChunkedArray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors scaled to length 1, and which of them have a direction (and the width asked for, else the first one's)."""
    lists = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(lists)
    sizes = np.array([-1 if v is None else v for v in pa.compute.list_value_length(lists).to_pylist()], np.int64) if lists.null_count else np.diff(lists.offsets.to_numpy())
    width = width if width is not None else int(sizes.max(initial=0))
    ok = sizes == width
    out = np.zeros((n, width))
    if width and ok.any():
        flat = lists.filter(pa.array(ok)).flatten()
        out[ok] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)  # null becomes nan
    size = np.sqrt((out * out).sum(1))
    ok &= np.isfinite(size) & (size > 0)
    out[~ok] = 0
    out[ok] /= size[ok, None]
    return out, ok


class _Best:
    """The best k things for each query, of those seen.  Things come in the order that settles ties, and may come in parts."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k, self.seen = queries, k, 0
        self.row, self.at, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.edge = np.full(queries, -np.inf)

    def add(self, score: np.ndarray, at: np.ndarray) -> None:
        """score: queries x rows, -inf for rows that take no part; at: which thing each row is, rising."""
        edge = self.edge
        if score.shape[1] > 4 * self.k:  # of these rows alone so many are as good as a thing's best
            firsts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
            if len(firsts) == len(at):
                edge = np.maximum(edge, np.partition(score, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((score >= edge[:, None]) & (score > -np.inf))
        row, at, score = np.concatenate([self.row, row]), np.concatenate([self.at, at[col]]), np.concatenate([self.score, score[row, col]])
        order = np.lexsort((-score, at, row))
        row, at, score = row[order], at[order], score[order]
        one = np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1]))[: len(row)]  # a thing's parts: the best counts
        row, at, score = row[one], at[one], score[one]
        order = np.lexsort((at, -score, row))
        row, at, score = row[order], at[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < self.k
        self.row, self.at, self.score = row[top], at[top], score[top]
        last = rank[top] == self.k - 1
        self.edge[self.row[last]] = self.score[last]


def blocks(queries: DataFrame, size: int = BLOCK) -> Iterator[pa.Table]:
    """The rows of queries, at most `size` at a time.  Beyond one block they lie in the shared folder, so the driver holds one."""
    spark = queries.sparkSession
    kept = keep(queries.withColumn("__i", F.monotonically_increasing_id()))
    counts = kept.groupBy(F.shiftright("__i", 33).alias("__p")).agg(F.count("*").alias("n")).orderBy("__p").collect()  # a line a partition
    total = sum(r.n for r in counts)
    if total <= size:
        yield kept.drop("__i").toArrow()
        return
    before = dict(zip([r["__p"] for r in counts], np.cumsum([0, *(r.n for r in counts)])[:-1].tolist(), strict=True))
    offsets = spark.createDataFrame(list(before.items()), "__p long, __before long")
    place = F.col("__before") + F.col("__i") - F.shiftleft("__p", 33)
    folder = f"{checkpoint_folder(spark)}/queries-{uuid.uuid4().hex}"
    kept.withColumn("__p", F.shiftright("__i", 33)).join(offsets, "__p").withColumn("__block", F.floor(place / size).cast("int")).drop("__i", "__p", "__before").write.partitionBy("__block").parquet(folder)
    for b in range(-(-total // size)):
        yield spark.read.schema(queries.schema).parquet(f"{folder}/__block={b}").toArrow()


def _scored(rows: DataFrame, block: pa.Table, k: int, thing: str) -> DataFrame:
    """query_id, the thing's column and similarity: each partition's best k things of rows (sorted in it) for every query."""
    ids = block.column("query_id").combine_chunks()
    q, usable = _unit(block.column("vector"))
    kind, kind_q = rows.schema[thing].dataType, pa.types.is_integer(ids.type)

    def run(batches):
        best, names, last, count = _Best(len(q), k), {}, None, -1
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                part = b.slice(start, ROWS)
                x, ok = _unit(part.column("vector"), q.shape[1])
                key = part.column(thing).to_pylist()
                at = []
                for v in key:
                    if count < 0 or v != last:
                        count, last = count + 1, v
                    at.append(count)
                score = np.round(q @ x.T, DIGITS)
                score[:, ~ok] = -np.inf
                score[~usable] = -np.inf
                at = np.array(at, np.int64)
                names.update(zip(at.tolist(), key, strict=True))
                best.add(score, at)
                if len(names) > 4 * len(best.at) + ROWS:
                    held = set(best.at.tolist()) | {count}
                    names = {i: v for i, v in names.items() if i in held}
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.row)), pa.array([names[i] for i in best.at.tolist()], b_type), pa.array(best.score)], ["query_id", thing, "similarity"])

    b_type = pa.int64() if kind.simpleString() in ("bigint", "int") else pa.string()
    return rows.mapInArrow(run, f"query_id {'long' if kind_q else 'string'}, `{thing}` {'long' if b_type == pa.int64() else 'string'}, similarity double")


def _first(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query, with rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def _each_block(queries: DataFrame, search, size: int) -> DataFrame:
    """What search gives for each block of queries; more than one result lies in the shared folder, not in a growing plan."""
    spark, out, first = queries.sparkSession, f"{checkpoint_folder(queries.sparkSession)}/found-{uuid.uuid4().hex}", None
    n = 0
    for n, block in enumerate(blocks(queries.select("query_id", "vector"), size)):  # noqa: B007
        found = search(block)
        if block.num_rows < size and n == 0:
            return found
        found.write.mode("append").parquet(out)
        first = found.schema
    return spark.read.schema(first).parquet(out)


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """query_id, rank, message_id, similarity: the k vectors (message_id, vector) nearest to each query (query_id, vector).

    Ties go to the smaller message_id.  A message with two vectors is found by the nearer one.  Query ids are unique; ids are longs
    or strings.  A query without a direction finds nothing.
    """
    rows = embeddings.select("message_id", "vector").filter("message_id IS NOT NULL").repartition("message_id").sortWithinPartitions("message_id")

    def search(part: pa.Table) -> DataFrame:
        return _first(_scored(rows, part, k, "message_id"), k, F.desc("similarity"), F.col("message_id")).select("query_id", "rank", "message_id", "similarity")

    return _each_block(queries, search, block)


def semantic_search_many(embeddings: DataFrame, messages: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """For each query the k messages nearest to it, as `semantic_search` with distinct finds them: query_id, rank, message_id,
    distance."""
    known = embeddings.join(messages.select(F.col("id").alias("message_id")).distinct(), "message_id", "left_semi")
    return nearest(known, queries, k, block).select("query_id", "rank", "message_id", (1 - F.col("similarity")).alias("distance"))


def relevant_context_many(edges: DataFrame, embeddings: DataFrame, queries: DataFrame, as_of: str, top: int = 0, f: R.Filters = R.Filters(), weights: R.Weights = R.Weights(), include_pruned: bool = False, block: int = BLOCK) -> DataFrame:  # noqa: B008
    """`relevant_context` for each query (query_id, vector): the facts' columns, similarity, score, query_id and rank.

    Pool, pruning, score and cut are as for one query.  Facts come with their sources' vectors once; each task finds its best
    facts for a block of queries.  Facts without an embedded source come last in a pool, the latest first; they are the same for all
    queries, and no more than a pool holds.
    """
    n, size = R.pool_size(top)
    w = weights.effective()
    rows = edges.filter(R.retrievable(f))
    us = X.micros(F.col("last_reinforced"))
    at = rows.select("id", us.alias("us"), F.explode("source_message_ids").alias("message_id")).join(embeddings.select("message_id", "vector"), "message_id")
    with_vectors = keep(at.select((-F.col("us")).alias("us"), "id", "vector").repartition("id").sortWithinPartitions("us", "id"))
    directed = F.coalesce(X.cosine(F.col("vector"), F.col("vector")), F.lit(0.0)) > 0
    none = rows.join(with_vectors.filter(directed).select("id").distinct(), "id", "left_anti")

    def latest(some: DataFrame) -> list:
        return [r.id for r in some.select("id", us.alias("us")).orderBy(F.desc("us"), "id").limit(size).collect()]

    others, all_ = latest(none), latest(rows)
    kind = dict(edges.dtypes)["id"]

    def literal(ids: list) -> Column:
        return F.array(*[F.lit(i).cast(kind) for i in ids]) if ids else F.array().cast(f"array<{kind}>")

    def search(part: pa.Table) -> DataFrame:
        found = _scored(with_vectors, part, size, "id").withColumn("id", F.col("id").cast(kind))
        asked = part.select(["query_id"]).append_column("void", pa.array(~_unit(part.column("vector"))[1]))
        asked = edges.sparkSession.createDataFrame(asked)
        filled = asked.select("query_id", F.explode(F.when(F.col("void"), literal(all_)).otherwise(literal(others))).alias("id")).withColumn("similarity", F.lit(None).cast("double"))
        both = found.unionByName(filled).join(rows, "id")
        pool = _first(both, size, F.desc_nulls_last("similarity"), us.desc(), F.col("id"))
        kept = pool if include_pruned else pool.filter(~R.prunable(as_of))
        kept = kept.withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
        score = w.similarity * F.col("similarity") + w.confidence * X.effective_confidence(as_of) + w.importance * F.col("importance")
        ranked = kept.withColumn("score", score).drop("rank")
        return _first(ranked, n, F.desc("score"), F.desc("similarity"), us.desc(), F.col("id"))

    return _each_block(queries, search, block)


# --- the index -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cells:
    """Centres of the cells (of length 1), and what one step of a residual code is worth in each place."""

    centres: np.ndarray
    step: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centres.T, axis=1)


#: Vectors that the centres are fitted on, at most; cells at most; rows and queries of one group of a search.
SAMPLE, MOST_CELLS, GROUP_ROWS, GROUP_QUERIES = 20_000, 4096, 50_000, 2_000


def fit_cells(embeddings: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 8, seed: int = 0) -> Cells:
    """Cells by k-means on `sample` vectors at most, chosen by a hash of their ids; about the root of all vectors, if not given."""
    some = embeddings.select("message_id", "vector").filter("vector IS NOT NULL")
    if cells is None:
        cells = int(np.clip(np.sqrt(some.count()), 1, MOST_CELLS))
    x, ok = _unit(some.orderBy(F.xxhash64("message_id", F.lit(seed)), "message_id").limit(sample).toArrow().column("vector"))
    x = x[ok]
    if not len(x):
        raise ValueError("no vector has a direction")
    centres = x[np.random.default_rng(seed).permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        size = np.linalg.norm(total, axis=1)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    rest = x - centres[np.argmax(x @ centres.T, axis=1)]
    return Cells(centres, np.maximum(np.abs(rest).max(axis=0), 1e-9) / 127)


@dataclass(frozen=True)
class VectorIndex:
    """Every vector's cell and code: message_id, cell (-1 without a direction), code (a byte a place; null without a direction)."""

    cells: Cells
    rows: DataFrame

    @classmethod
    def build(cls, embeddings: DataFrame, cells: Cells) -> VectorIndex:
        return cls(cells, keep(_coded(embeddings, cells)))

    def add(self, new: DataFrame) -> VectorIndex:
        """With new vectors; those of messages already there take their places."""
        return self.without(new.select("message_id"))._with(_coded(new, self.cells))

    def _with(self, rows: DataFrame) -> VectorIndex:
        return replace(self, rows=self.rows.unionByName(rows))

    def without(self, ids: DataFrame) -> VectorIndex:
        return replace(self, rows=self.rows.join(ids.select(F.col(ids.columns[0]).alias("message_id")).distinct(), "message_id", "left_anti").select(*self.rows.columns))

    def save(self, folder: str) -> None:
        """Rows by cell, so that readers skip the files of other cells; a large cell is dealt over several files."""
        spark = self.rows.sparkSession
        self.rows.repartitionByRange("cell", F.xxhash64("message_id")).sortWithinPartitions("cell").write.parquet(f"{folder}/rows")
        both = [(i, c.tolist()) for i, c in enumerate(self.cells.centres)] + [(-1, self.cells.step.tolist())]
        spark.createDataFrame(both, "cell int, vector array<double>").coalesce(1).write.parquet(f"{folder}/cells")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> VectorIndex:
        got = sorted(map(tuple, spark.read.parquet(f"{folder}/cells").collect()))
        return cls(Cells(np.array([v for _, v in got[1:]]), np.array(got[0][1])), spark.read.parquet(f"{folder}/rows"))

    def search(self, embeddings: DataFrame, queries: DataFrame, k: int = 10, probes: int = 8, rerank: int = 4) -> DataFrame:
        """query_id, rank, message_id, similarity, as `nearest` gives them, for what lies in the `probes` cells nearest to each query.

        Codes choose rerank * k rows for each query; their vectors are then compared exactly.  With all cells and enough rows to
        compare, the result is that of `nearest`.  Rows and queries of a cell meet in groups of bounded size.
        """
        centres, step, keep_ = self.cells.centres, self.cells.step, rerank * k
        sizes = keep(self.rows.filter("cell >= 0").groupBy("cell").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("chunks")))
        kind = dict(queries.dtypes)["query_id"]

        def probe(batches):
            for b in batches:
                q, ok = _unit(b.column(b.schema.get_field_index("vector")), centres.shape[1])
                cells = np.argsort(-np.round(q @ centres.T, DIGITS), axis=1, kind="stable")[:, :probes]
                row = np.repeat(np.flatnonzero(ok), cells.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("query_id")).take(pa.array(row)), pa.array(cells[ok].ravel(), pa.int32()), b.column(b.schema.get_field_index("vector")).take(pa.array(row))], ["query_id", "cell", "vector"])

        vector = dict(queries.dtypes)["vector"]
        probed = keep(queries.select("query_id", "vector").mapInArrow(probe, f"query_id {kind}, cell int, vector {vector}"))
        asked = probed.groupBy("cell").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("parts"))
        plan = keep(sizes.join(asked, "cell"))  # a line a cell

        def share(n: str, key: str) -> Column:
            return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

        def every(n: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        left = self.rows.join(F.broadcast(plan), "cell").withColumn("chunk", share("chunks", "message_id")).withColumn("part", every("parts"))
        right = probed.join(F.broadcast(plan), "cell").withColumn("part", share("parts", "query_id")).withColumn("chunk", every("chunks"))
        by = ["cell", "chunk", "part"]

        def compare(rows: pa.Table, asked: pa.Table) -> pa.Table:
            rows = rows.sort_by("message_id")
            q, _ = _unit(asked.column("vector"), centres.shape[1])
            best = _Best(len(q), keep_)
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(-1, len(step))
            for start in range(0, len(code), ROWS):
                x = centres[rows.column("cell")[0].as_py()] + code[start : start + ROWS] * step
                x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
                best.add(np.round(q @ x.T, DIGITS), np.arange(start, start + len(x)))
            return pa.table({"query_id": asked.column("query_id").take(pa.array(best.row)), "message_id": rows.column("message_id").take(pa.array(best.at)), "near": pa.array(best.score)})

        message = dict(self.rows.dtypes)["message_id"]
        near = left.select(*by, "message_id", "code").groupBy(*by).cogroup(right.select(*by, "query_id", "vector").groupBy(*by)).applyInArrow(lambda r, a: compare(r, a), f"query_id {kind}, message_id {message}, near double")
        chosen = _first(near, keep_, F.desc("near"), F.col("message_id")).select("query_id", "message_id")
        exact = chosen.join(embeddings.select("message_id", F.col("vector").alias("__v")), "message_id").join(queries.select("query_id", "vector"), "query_id")
        exact = exact.withColumn("similarity", F.round(X.cosine(F.col("vector"), F.col("__v")), DIGITS)).groupBy("query_id", "message_id").agg(F.max("similarity").alias("similarity"))
        return _first(exact.filter("similarity IS NOT NULL"), k, F.desc("similarity"), F.col("message_id")).select("query_id", "rank", "message_id", "similarity")


def _coded(embeddings: DataFrame, cells: Cells) -> DataFrame:
    def run(batches):
        for b in batches:
            x, ok = _unit(b.column(b.schema.get_field_index("vector")), cells.centres.shape[1])
            of = cells.of(x) if len(x) else np.zeros(0, np.int64)
            code = np.clip(np.rint((x - cells.centres[of]) / cells.step), -127, 127).astype(np.int8)
            codes = [c.tobytes() if o else None for c, o in zip(code, ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("message_id")), pa.array(np.where(ok, of, -1), pa.int32()), pa.array(codes, pa.binary())], ["message_id", "cell", "code"])

    return embeddings.select("message_id", "vector").mapInArrow(run, f"message_id {dict(embeddings.dtypes)['message_id']}, cell int, code binary")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (query_id, message_id) that were found; 1 if there are none."""
    hit = exact.select("query_id", "message_id").join(found.select("query_id", "message_id", F.lit(1).alias("hit")), ["query_id", "message_id"], "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("r")).first().r


def probes_for(index: VectorIndex, embeddings: DataFrame, queries: DataFrame, k: int = 10, target: float = 0.9, rerank: int = 4) -> int:
    """The fewest probes, of 1, 2, 4, ... and all cells, whose recall on these queries reaches the target."""
    exact, probes, cells = keep(nearest(embeddings, queries, k)), 1, len(index.cells.centres)
    while probes < cells and recall(index.search(embeddings, queries, k, probes, rerank), exact) < target:
        probes *= 2
    return min(probes, cells)
