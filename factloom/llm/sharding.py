"""Contiguous shards of nearly equal bytes, cut from global prefix sums.

Rows are ordered once by a digest of the text and by id (only these, size and checksum travel, never the text), so that equal
texts lie side by side, in one shard but for groups on a cut.  That order is kept in the shared folder, so that its partitions stay the same for the three light passes that follow: bytes of each partition, rows of
each shard in each partition, and the assignment.  The driver sees one line for each partition and shard, never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import cut, table

N_SHARDS = 40
ROW_BYTES = 16


def _partition_totals(batches):
    """(partition, bytes, rows) of this partition."""
    size = rows = 0
    for b in batches:
        size += int(b.column("size").to_numpy().sum())
        rows += b.num_rows
    yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "bytes": [size], "rows": [rows]})


def _shard_of(start: np.ndarray, size: np.ndarray, total: int, n: int) -> np.ndarray:
    """The shard in whose equal share of all bytes the middle of the row lies."""
    return np.minimum((2 * start + size) * n // (2 * total), n - 1)


def _walk(batches, before: dict[int, int], total: int, n: int):
    at = before.get(TaskContext.get().partitionId(), 0)
    for b in batches:
        size = b.column("size").to_numpy()
        ends = at + np.cumsum(size)
        if b.num_rows:
            at = int(ends[-1])
        yield b, _shard_of(ends - size, size, total, n)


def shard_by_bytes(df: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assigns each row of df to one of n_shards contiguous ranges of the order by text digest and id.

    Returns id, size (UTF-8 bytes of the text, 0 for null, plus 16), text_crc32 (of '' for null), law ('bytes'), shard,
    slot (from 0 without gaps in each shard) and grown_shard (null: this law doesn't say where rows go if shards are
    added).  Shards differ from an equal share by less than the two rows at their ends.  Rows with equal texts are neighbours:
    they share a shard, unless one of the n_shards - 1 cuts falls among them, as it must where they are more than a shard
    holds.  Among them rows go by id (null first), then by place in the input, so that a text or an id with very many rows is
    dealt over partitions and shards as any other rows are.  An empty table gives an empty result; other columns of df are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("at"))
    rows = cut(rows.orderBy("digest", "text_crc32", "size", F.col("id").asc_nulls_first(), "at").drop("digest", "at"))
    parts = sorted((r.part, r.bytes, r.rows) for r in rows.mapInArrow(_partition_totals, "part long, bytes long, rows long").collect())
    before, total = {}, 0
    for part, size, _ in parts:
        before[part], total = total, total + size

    def counts(batches):
        n = np.zeros(n_shards, np.int64)
        for _, shard in _walk(batches, before, total, n_shards):
            n += np.bincount(shard, minlength=n_shards)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()] * len(k), pa.int32()), "shard": pa.array(k, pa.int32()), "rows": pa.array(n[k], pa.int64())})

    base, filled = {}, np.zeros(n_shards, np.int64)
    for r in sorted(rows.mapInArrow(counts, "part int, shard int, rows long").collect()):
        base[r.part, r.shard] = int(filled[r.shard])
        filled[r.shard] += r.rows

    def assign(batches):
        part = TaskContext.get().partitionId()
        given = np.array([base.get((part, s), 0) for s in range(n_shards)], np.int64)
        for b, shard in _walk(batches, before, total, n_shards):
            n = np.bincount(shard, minlength=n_shards)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])  # shards rise along the order
            slot = given[shard] + np.arange(len(shard)) - first[shard]
            given += n
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("size"), b.column("text_crc32"), pa.array(shard, pa.int32()), pa.array(slot, pa.int64())], ["id", "size", "text_crc32", "shard", "slot"])

    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(assign, f"id {kind}, size long, text_crc32 long, shard int, slot long")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes; nulls, ties and repeats as in `shard_by_bytes`."""
    return shard_by_bytes(table(spark, sf_dir, "documents"))
