"""Windows of messages: by count, and by the anchored rule of the live path."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import expr as X
from factloom.operators.analytics import unprocessed_with_text
from factloom.store import keep

COUNT_SIZE = 8
LIVE_SIZE, LIVE_SECONDS = 10, 300


def count_windows(rows: DataFrame, key: str, *order: str, size: int = COUNT_SIZE) -> DataFrame:
    """Consecutive windows of `size` rows of each key, the last one shorter: window_index is added."""
    n = size if size > 0 else COUNT_SIZE
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("window_index", F.floor((F.row_number().over(w) - 1) / n).cast("int"))


@dataclass
class Piece:
    """The part of one conversation that one partition holds, in order."""

    times: np.ndarray

    def starts(self, size: int, limit: int) -> np.ndarray:
        """Where the next window begins, for a window that begins at each place; len(times) if not in this piece."""
        late = np.searchsorted(self.times, self.times + limit, side="right")
        return np.minimum(np.arange(len(self.times)) + size, late)


def walked(times: np.ndarray, entries: list[int], size: int, limit: int) -> dict[int, tuple[int, int]]:
    """For each entry (where the open window began): how many windows begin after it, and where the last of them begins.

    Ways that meet go on as one, so all entries together cost little more than one of them.
    """
    after = Piece(times).starts(size, limit)
    out, met = {}, {}
    for entry in entries:
        way, at = [entry], entry
        while at not in met and after[at] < len(times):
            at = int(after[at])
            way.append(at)
        more, last = met.get(at, (0, at))
        for k, place in enumerate(way):
            met.setdefault(place, (more + len(way) - 1 - k, last))
        out[entry] = met[entry]
    return out


def live_windows(messages: DataFrame, key: str = "conversation_id", size: int = LIVE_SIZE, seconds: int = LIVE_SECONDS) -> DataFrame:
    """window_index of each message under the live rule: a message begins a window if the open one has `size` messages or
    began more than `seconds` before; elapsed time counts from the window's first message.

    Messages are sorted once, by conversation and time, so a busy conversation lies in many partitions.  A window that is open at
    a partition's end began among the last `size` messages before it: each partition tells, for every such beginning, how many
    windows follow and where the last one begins.  These short tables are put together in order, and each partition then
    numbers its messages from the window that is open at its beginning.  The driver sees `size` + 2 short lines a partition.
    """
    limit, kind = seconds * 1_000_000, messages.schema[key].dataType
    rows = keep(messages.withColumn("__us", X.micros(F.col("timestamp"))).orderBy(key, "__us", "id"))

    def held(batches) -> list[tuple[object, list[int]]]:
        """The partition's pieces: key and times."""
        out: list[tuple[object, list[int]]] = []
        for b in batches:
            for k, us in zip(b.column("key").to_pylist(), b.column("us").to_pylist(), strict=True):
                if not out or out[-1][0] != k:
                    out.append((k, []))
                out[-1][1].append(us)
        return out

    line = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", kind), T.StructField("last", kind), T.StructField("pieces", T.IntegerType()), T.StructField("tail", T.ArrayType(T.LongType()))])

    def ends(batches):
        p = held(batches)
        if p:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([p[0][0]]), pa.array([p[-1][0]]), pa.array([len(p)], pa.int32()), pa.array([p[-1][1][-size:]], pa.list_(pa.int64()))], ["part", "first", "last", "pieces", "tail"])

    short = rows.select(F.col(key).alias("key"), F.col("__us").alias("us"))
    known = sorted(short.mapInArrow(ends, line).collect(), key=lambda r: r.part)
    halo, tail = {}, []  # times of the last messages before a partition, of the conversation that goes on in it
    for i, r in enumerate(known):
        tail = tail if i and known[i - 1].last == r.first else []
        halo[r.part] = tail
        tail = (tail if r.pieces == 1 else []) + list(r.tail)
        tail = tail[-size:]

    def tables(batches):
        p, part = held(batches), TaskContext.get().partitionId()
        if p:
            before = halo[part]
            times = np.array(before + p[0][1], np.int64)
            after = Piece(times).starts(size, limit)
            entries = [c for c in range(len(before)) if after[c] >= len(before)] if before else [0]
            found = [(c, n, len(times) - at) for c, (n, at) in walked(times, entries, size, limit).items()]
            if len(p) > 1:
                n, at = walked(np.array(p[-1][1], np.int64), [0], size, limit)[0]
                found.append((-1, n, len(p[-1][1]) - at))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int32()), *(pa.array(x, pa.int32()) for x in zip(*found, strict=True))], ["part", "entry", "windows", "back"])

    found = {(r.part, r.entry): (r.windows, r.back) for r in short.mapInArrow(tables, "part int, entry int, windows int, back int").collect()}
    opened, index, back = {}, 0, 0  # the window that is open at a partition's beginning: index, messages, first time
    for r in known:
        entry = 0
        if halo[r.part]:
            entry = len(halo[r.part]) - back
            opened[r.part] = (index, back, halo[r.part][entry])
        else:
            index = 0
        n, back = found[r.part, entry]
        index += n
        if r.pieces > 1:
            index, back = found[r.part, -1]

    def number(batches):
        last, begun, index, n, first = None, False, 0, 0, 0
        entry = opened.get(TaskContext.get().partitionId())
        for b in batches:
            out = []
            for k, us in zip(b.column(key).to_pylist(), b.column("__us").to_pylist(), strict=True):
                if not begun and entry is not None:
                    last, (index, n, first) = k, entry
                if not begun and entry is None or k != last:
                    last, index, n, first = k, 0, 1, us
                elif n >= size or us - first > limit:
                    index, n, first = index + 1, 1, us
                else:
                    n += 1
                begun = True
                out.append(index)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], [*b.schema.names, "window_index"])

    return rows.mapInArrow(number, T.StructType([*rows.schema.fields, T.StructField("window_index", T.IntegerType())])).select(*messages.columns, "window_index")


def recoverable(messages: DataFrame, entities: DataFrame) -> DataFrame:
    """What was stored but not processed, with the sender's name as speaker; null where the sender isn't known, which fails the
    message alone."""
    names = entities.select(F.col("id").alias("sender_id"), F.col("canonical_name").alias("speaker"))
    return messages.filter(~F.col("processed") & X.usable_text().isNotNull()).join(names, "sender_id", "left")


def recovery_windows(messages: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Live windows of what was stored but not processed.  With entities, messages of unknown senders are left out, and
    recovery_errors counts them."""
    return live_windows(unprocessed_with_text(messages) if entities is None else recoverable(messages, entities).filter("speaker IS NOT NULL"))


def recovery_errors(messages: DataFrame, entities: DataFrame) -> DataFrame:
    return recoverable(messages, entities).agg(F.count_if(F.col("speaker").isNull()).alias("errors"), F.count_if(F.col("speaker").isNotNull()).alias("recovered"))


def window_rows(rows: DataFrame, key: str = "conversation_id") -> DataFrame:
    """One row a window: its message ids in order and the source type that its media give."""
    g = rows.groupBy(key, "window_index").agg(F.transform(F.array_sort(F.collect_list(F.struct(X.micros(F.col("timestamp")).alias("us"), "id"))), lambda x: x["id"]).alias("ids"), F.collect_list("media_type").alias("media"))
    return g.select(key, "window_index", "ids", X.window_source_type(F.col("media")).alias("source_type"))
