"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these (space, tab, line feed, vertical tab, form feed, return).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names.  Where it names none, a session on this machine alone gets a folder of it; on
    a cluster that is an error, for executors would write to disks that others can't see."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="factloom-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: its rows and partitions stay as they are."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remainder(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null for null."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def is_remainder(col: Column, n: int, k: int) -> Column:
    return F.coalesce(remainder(col, n) == k, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Pieces of the batches with about max_bytes of text each (one row at least), and their text, null as ''."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        col = pc.fill_null(col.cast(pa.large_string()), "")
        size = pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < len(size):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
            yield batch.slice(at, stop - at), col.slice(at, stop - at)
            at = stop


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offsets at which they begin and end."""
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(col: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (A-Z lowered, if asked), and each text's bounds among them."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(col) if lower else col)
    offsets = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(keep)])
    bounds = kept[offsets - offsets[0]]
    return (flat if keep.all() else flat.filter(pa.array(keep))), bounds


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i; empty ranges give 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def word_hashes(flat: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A 64-bit hash of each word, each word's index among the distinct ones, and these."""
    import xxhash

    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), flat
    d = flat.dictionary_encode()
    codes = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, d.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(d.dictionary))
    return own[codes], codes, d.dictionary


def _release() -> None:
    """Gives memory that this worker no longer needs back to the system: workers outlive their tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(f):
    """f, a function over batches, with memory given back at its end."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            _release()

    return run


def tidy_table(f):
    """f, a function from table to table, with memory given back after large tables: for small ones that would take longer
    than f itself."""

    def run(t: pa.Table) -> pa.Table:
        large = t.nbytes > 1 << 20
        try:
            return f(t)
        finally:
            if large:
                _release()

    return run


def summed(df: DataFrame, f, kind=np.float64, chunk: int = 8192, fan: int = 64) -> np.ndarray:
    """The sum of the arrays (of one length) that f makes of each partition's batches; without partitions an empty array.

    Partitions send their arrays (as `kind`) in chunks, without those of zeros.  The chunks of `fan` partitions at a time are
    added up first, then these sums: no task reads all arrays, and the driver gets one, however many partitions there are.
    """

    def run(batches):
        group, x = TaskContext.get().partitionId() // fan, np.asarray(f(batches), kind)
        parts = [(i, x[i : i + chunk]) for i in range(0, len(x), chunk)]
        parts = [(i, p) for i, p in parts if p.any() or i + chunk >= len(x)]  # the last one tells the length
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int64()), pa.array([group] * len(parts), pa.int32()), pa.array([p.tobytes() for _, p in parts], pa.binary())], ["at", "part", "x"])

    def adder(have):
        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_buffer(), have).astype(np.float64) for v in t.column("x"))
            return pa.table({"at": t.column("at").slice(0, 1), "part": t.column("part").slice(0, 1), "x": pa.array([total.tobytes()], pa.binary())})

        return tidy_table(add)

    schema = "at long, part int, x binary"
    some = df.mapInArrow(tidy(run), schema).groupBy("at", "part").applyInArrow(adder(kind), schema)
    got = {r.at: np.frombuffer(r.x) for r in some.groupBy("at").applyInArrow(adder(np.float64), schema).collect()}
    out = np.zeros(max((at + len(x) for at, x in got.items()), default=0))
    for at, x in got.items():
        out[at : at + len(x)] = x
    return out
