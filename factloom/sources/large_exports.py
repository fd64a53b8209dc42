"""Text exports of any size: a file is read by lines in many partitions, not whole in one task.

What a header line is depends on the message that is open: a header earlier than it, by more than a minute, continues it.  So each
partition tells, for every time stamp that the open message may have at its beginning, which message is open at its end.  That is
a short table: whatever the entry, the ways meet at the first line that is late enough.  The tables are put together in the order of
the file, and each partition then splits its lines from the message that is open at its beginning.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources import exports as E
from factloom.store import keep

#: What is open: no message, one whose stamp can't be read, else the seconds of its stamp.
NONE, UNREAD = -(1 << 60), -(1 << 60) + 1
LATE = 1 << 60
TOLERANCE = int(E.TOLERANCE.total_seconds())
EPOCH = dt.datetime(1970, 1, 1)


def event(line: str) -> tuple[int, tuple | None] | None:
    """What a line may do: (what it opens, its header), or None for a line that only continues."""
    m = E.HEADER.match(line)
    if m:
        stamp = E.parse_stamp(m[1], m[2])
        return (UNREAD if stamp is None else int((stamp - EPOCH).total_seconds())), (m[1], m[2], m[3], m[4])
    return (NONE, None) if E.NOTICE.match(line) else None


def accepted(open_: int, new: int) -> bool:
    """Whether a line that would open `new` does so while `open_` is open."""
    return min(open_, new) <= UNREAD or new >= open_ - TOLERANCE


class Table:
    """Of a run of events: what is open at its end, for any message open at its beginning."""

    def __init__(self, opens: list[int]):
        n, end = len(opens), [0] * len(opens)
        stack: list[int] = []  # places, the nearest last; their values fall towards it
        falls: list[int] = []
        value = [o if o > UNREAD else LATE for o in opens]  # whatever is open, such a line is accepted
        for j in reversed(range(n)):
            nxt = j + 1 if opens[j] <= UNREAD else self._first(stack, falls, opens[j] - TOLERANCE)
            end[j] = end[nxt] if nxt is not None and nxt < n else j
            while stack and value[stack[-1]] <= value[j]:
                stack.pop()
                falls.pop()
            stack.append(j)
            falls.append(-value[j])
        #: (value, place): an open message's stamp, less the tolerance, up to the value leads to what this place opens
        self.steps: list[tuple[int, int]] = []
        for j in reversed(stack):
            if self.steps and self.steps[-1][1] == end[j]:
                self.steps[-1] = (value[j], end[j])
            else:
                self.steps.append((value[j], end[j]))
        self.any = end[0] if n else None

    @staticmethod
    def _first(stack: list[int], falls: list[int], least: int) -> int | None:
        k = bisect_right(falls, -least) - 1
        return stack[k] if k >= 0 else None


def at_end(steps: list[tuple[int, int]], any_: int | None, open_: int) -> int | None:
    """The place that is open at the end; None: what was open at the beginning still is."""
    if open_ <= UNREAD:
        return any_
    k = bisect_left([s[0] for s in steps], open_ - TOLERANCE)
    return steps[k][1] if k < len(steps) else None


def _pieces(batches) -> Iterator[tuple[str, list[str]]]:
    """The partition's files and lines."""
    name, lines = None, []
    for b in batches:
        for f, line in zip(b.column("conversation_id").to_pylist(), b.column("line").to_pylist(), strict=True):
            if f != name and lines:
                yield name, lines
                lines = []
            name = f
            lines.append(line)
    if lines:
        yield name, lines


def split_lines(lines: DataFrame) -> DataFrame:
    """What `exports.split_files` gives, from lines (conversation_id, at, line) in the order of `at`.

    A file may lie in any number of partitions.  The driver sees one short table a partition.  Only messages that pass the end of a
    partition are put together by a shuffle.  Files without lines, or without a header, have no message.
    """
    rows = keep(lines.select("conversation_id", "at", "line").orderBy("conversation_id", "at"))

    def tables(batches):
        part, found = TaskContext.get().partitionId(), []
        for name, held in _pieces(batches):
            opens, where = [], []
            for i, line in enumerate(held):
                e = event(line)
                if e:
                    opens.append(e[0])
                    where.append(i)
            t = Table(opens)
            found.append((part, len(found), name, [[v, opens[j], where[j]] for v, j in t.steps], [opens[t.any], where[t.any]] if opens else None))
            if len(found) > 2:  # only the first and the last file go on in another partition
                del found[1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())], strict=True)], ["part", "piece", "name", "steps", "any"])

    got = sorted(rows.mapInArrow(tables, "part int, piece int, name string, steps array<array<long>>, any array<long>").collect(), key=lambda r: (r.part, r.piece))
    entry, name, open_, message = {}, None, NONE, -1  # by partition: what is open at its beginning, and which message
    for r in got:
        if r.name != name:
            name, open_, message = r.name, NONE, -1
        elif r.piece == 0:
            entry[r.part] = (open_, message)
        steps, any_ = [(s[0], k) for k, s in enumerate(r.steps)], r.any
        end = any_ if open_ <= UNREAD else (r.steps[k][1:] if (k := at_end(steps, None, open_)) is not None else None)
        if end is not None:
            open_, message = end[0], (r.part << 40 | end[1]) if end[0] != NONE else -1
            if r.piece:
                message |= 1 << 39 if message >= 0 else 0
    spans = {m for _, m in entry.values() if m >= 0}

    def split(batches):
        part, out = TaskContext.get().partitionId(), []
        for k, (name, held) in enumerate(_pieces(batches)):
            open_, message = entry.get(part, (NONE, -1)) if k == 0 else (NONE, -1)
            row = [name, message, -1, None, None, None, [], None] if message >= 0 else None
            n = 0
            for i, line in enumerate(held):
                e = event(line)
                if e and accepted(open_, e[0]):
                    if row and row[6]:
                        out.append(row)
                    open_, row = e[0], None
                    if e[1]:
                        stamp = E.parse_stamp(e[1][0], e[1][1])
                        row = [name, part << 40 | (1 << 39 if k else 0) | i, n, *e[1][:3], [e[1][3]], stamp]
                        n += 1
                elif row:
                    row[6].append(line)
            if row and row[6]:
                out.append(row)
        if out:
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.timestamp("us")]
            cols = [pa.array([("\n".join(x) if isinstance(x, list) else x) for x in col], t) for col, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([part] * len(out), pa.int32())], ["conversation_id", "message", "n", "date", "clock", "sender", "body", "stamp", "part"])

    parts = keep(rows.select("conversation_id", "line").mapInArrow(split, "conversation_id string, message long, n int, date string, clock string, sender string, body string, stamp timestamp_ntz, part int"))
    # positions: the messages that began in earlier partitions come first
    counts = parts.filter("n >= 0").groupBy("conversation_id", "part").agg(F.count("*").alias("here"))
    earlier = Window.partitionBy("conversation_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conversation_id", "part", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"))
    placed = parts.join(before, ["conversation_id", "part"], "left").withColumn("position", (F.col("n") + F.coalesce("before", F.lit(0))).cast("int"))
    long = F.col("message").isin(*spans) if spans else F.lit(False)
    whole = placed.filter(~long)
    own = F.col("n") >= 0
    joined = placed.filter(long).groupBy("conversation_id", "message").agg(*[F.max(F.when(own, F.col(c))).alias(c) for c in ("position", "date", "clock", "sender", "stamp")], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "body"))), lambda x: x["body"]), "\n").alias("body"))
    columns = ["conversation_id", "position", "date", "clock", "sender", "body", "stamp"]
    return whole.select(*columns).unionByName(joined.select(*columns))


def read_large_text_exports(spark: SparkSession, folder: str, zone: str = "UTC") -> DataFrame:
    """`exports.read_text_exports` for files of any size: Spark splits them by bytes, and each split is read by lines.

    A carriage return before a line feed is no part of a line; at the very end of a file it isn't either.
    """
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, lineSep="\n")
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "")
    return E.text_messages(split_lines(files.select(name.alias("conversation_id"), at.alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))), zone)
