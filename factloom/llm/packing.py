"""Best-fit packing planned on a length histogram.

Documents become token pieces; only their lengths are counted.  Best fit runs over at most MAX_TOKENS counts, not over
documents, and gives runs of slots.  A piece takes the slot that its rank among the pieces of its length has.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, slices, table, tidy, words

MAX_TOKENS, END = 2048, 0
#: Words whose ids a task remembers, at most; it then begins anew.
CACHE = 400_000
#: Words encoded at once, and marks after a word of letters, which the tokenizer splits from it.
LINE, MARKS = 1000, "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"


class Encoder:
    """Token ids of whole texts, equal to the tokenizer's own.

    The tokenizer's words never hold white space, so each stretch between ASCII white space is encoded by itself, once
    for all its occurrences; letters and the marks after them are words of their own.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.stems: dict[str, bytes] = {}
        self.ids, self.start, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems(self, new: list[str]) -> None:
        """Learns words of letters only: many to a line, for each gives one token that ends a word, its last."""
        for at in range(0, len(new), LINE):
            part = new[at : at + LINE]
            ids = self._encode([" ".join(part)])[0]
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                self.stems.update((w, raw[4 * i : 4 * j]) for w, i, j in zip(part, [0, *ends[:-1]], ends, strict=True))
            else:  # letters that the tokenizer takes apart
                self.stems.update(zip(part, (x.tobytes() for x in self._encode(part)), strict=True))

    def _learn(self, new: list[str]) -> None:
        cut_ = [w.rstrip(MARKS) for w in new]
        whole = [not s.isalpha() for s in cut_]
        stems = [w if odd else s for w, s, odd in zip(new, cut_, whole, strict=True)]
        marks = [w[len(s) :] for w, s in zip(new, stems, strict=True)]
        self._stems(list(dict.fromkeys(s for s, odd in zip(stems, whole, strict=True) if not odd and s not in self.stems)))
        others = list(dict.fromkeys(w for w in (*(s for s, odd in zip(stems, whole, strict=True) if odd), *marks) if w not in self.stems))
        self.stems.update(zip(others, (x.tobytes() for x in self._encode(others)), strict=True))
        got = [self.stems[s] + self.stems[m] for s, m in zip(stems, marks, strict=True)]
        n, flat = np.fromiter(map(len, got), np.int64, len(got)) // 4, np.frombuffer(b"".join(got), np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        k = len(self.known)
        while k + len(new) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[k + 1 : k + 1 + len(new)] = self.used + np.cumsum(n)
        self.used += len(flat)
        self.known.update(zip(new, range(k, k + len(new)), strict=True))

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END after each text, and each text's bounds."""
        # A-Z may be lowered first, for the tokenizer does so, unless a text may hold a special token's string
        flat, bounds = words(col, lower=not pc.any(pc.match_substring(col, "<|")).as_py())
        if len(self.known) > CACHE:
            self.clear()
        d = flat.dictionary_encode()
        names = d.dictionary.to_pylist()
        self._learn([w for w in names if w not in self.known])
        of = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[d.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)
        first, n = self.start[of], self.start[of + 1] - self.start[of]
        ends = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(ends[-1]) + np.repeat(first - ends[:-1], n)
        doc_ends = ends[bounds]
        out_ends = doc_ends + np.arange(len(doc_ends))
        out = np.full(out_ends[-1], END, np.uint32)
        shift = np.repeat(np.arange(len(bounds) - 1), np.diff(doc_ends))
        out[np.arange(len(take)) + shift] = self.ids[take]
        return out, out_ends


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def plan(counts: dict[int, int], room: int = MAX_TOKENS) -> dict[str, np.ndarray]:
    """Best-fit decreasing over counts: runs of slots (length, rank, seq, each, offset), ordered by length and rank.

    From `rank` on, pieces of this length go to sequences from `seq` on, `each` to a sequence, from `offset` on.
    """
    open_: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, sequences)
    free: list[int] = []
    runs, made = [], 0

    def put(left: int, seq: int, n: int) -> None:
        if left and n:
            if left not in open_:
                insort(free, left)
            open_.setdefault(left, []).append((seq, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                space = free[at]
                seq, n = open_[space].pop()
                if not open_[space]:
                    del open_[space], free[at]
            else:
                space, seq = room, made
                n = -(-left // (room // length))
                made += n
            each = space // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, seq, each, room - space))
                put(space - each * length, seq, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # one sequence takes what is left
                runs.append((length, rank, seq + full, each, room - space))
                put(space - left * length, seq + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(space, seq + full, n - full)
    table_ = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "seq", "each", "offset"), table_.T, strict=True))


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", room: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Token pieces of each text, with the partition that made them and their rank by length in it."""

    def run(batches):
        encoder, seen, part = Encoder(path), np.zeros(room + 1, np.int64), TaskContext.get().partitionId()
        for b, col in slices(batches, text_col, 2 << 20):
            ids, ends = encoder(col)
            size = np.diff(ends)
            n = -(-size // room)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * room
            length = np.minimum(room, size[doc] - start)
            at = ends[:-1][doc] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(at))
            order = np.argsort(length, kind="stable")
            by = length[order]
            first = np.searchsorted(by, by)
            rank = np.empty(len(by), np.int64)
            rank[order] = np.arange(len(by)) - first + seen[by]
            seen += np.bincount(length, minlength=room + 1)
            cols = [b.column(b.schema.get_field_index(id_col)).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc), pa.array(np.full(len(doc), part), pa.int64()), pa.array(rank)]
            names = [id_col, "piece", "start", "length", "ids_crc32", "part", "local"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, ends[-1]), pa.int32()), pa.array(ids.astype(np.int64))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = df.select(id_col, text_col)
    return rows.mapInArrow(tidy(run), f"`{id_col}` {dict(rows.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long, part long, local long" + ", ids array<long>" * with_ids)


def pack(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", room: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Packs every text of df into as few sequences of at most `room` tokens as best fit needs.

    Returns for each piece id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids, its ids.  A text is
    its token ids and one END; a null or empty text is END alone.  Only texts longer than room are cut.  Rows that
    share an id are packed each by itself; other columns are ignored; an empty table gives an empty result.
    Only counts by length (room of them) reach the driver.
    """
    made = cut(pieces(df, path or tokenizer_path(), id_col, text_col, room, with_ids))
    counts = cut(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    slots = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, room)
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    key = slots["length"] << 44 | slots["rank"]
    kept = [c for c in made.columns if c not in ("part", "local")]

    def assign(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(key, length << 44 | rank, side="right") - 1
            past = rank - slots["rank"][k]
            seq = slots["seq"][k] + past // slots["each"][k]
            offset = slots["offset"][k] + past % slots["each"][k] * length
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], [*kept, "sequence_id", "offset"])

    ranked = made.join(before, ["part", "length"]).withColumn("rank", F.col("local") + F.col("before")).select(*kept, "rank")
    return ranked.mapInArrow(tidy(assign), ", ".join(f"`{c}` {t}" for c, t in ranked.select(*kept).dtypes) + ", sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null and empty texts are one token; rows that share an id are packed each by itself; see `pack`."""
    return pack(table(spark, sf_dir, "documents"))
