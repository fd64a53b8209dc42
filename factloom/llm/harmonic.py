"""Harmonic packing: classes of reciprocal capacity, each class's bins filled with a fixed count of pieces.

Class k takes pieces of at most room / k tokens, and k of them fill a bin.  Texts may be cut, so each is cut at the tops of
classes, the largest first: then a bin of class k is short of `room` by room mod k at most (by less than two hundredths for the
small classes).  Each partition fills its own bins and needs to know of no other; there is no shuffle.  What lies in bins that
aren't full at a partition's end (one a class) is cut anew into sequences of `room` tokens and of powers of two, which need no
padding.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import slices, table, text_bytes, tidy

MAX_TOKENS, END = 2048, 1
#: Distinct stretches of text whose ids a task remembers, at most; it then begins anew.
REMEMBERED = 400_000
#: Stretches that are encoded together, and which can be.
LINE, EASY = 1000, re.compile(r" ?\S+")
#: Lead bytes of white space beyond ASCII.  Before a stretch, any character that begins so counts as white space.
SPACES_2, SPACES_3 = ((0xC2, 0x85), (0xC2, 0xA0)), ((0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))


def stretches(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts cut into stretches, and each text's bounds among them.

    A byte-level tokenizer's pattern never joins what lies on both sides of such a cut, nor looks past it: before each run of ASCII
    white space that something other than white space precedes, behind a line feed that is such a run by itself, and (unless
    a text may hold a special token) between a letter and a mark of ASCII.
    """
    data, offsets = text_bytes(col)
    n = len(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    plain = (data > 32) & (data < 127)
    one, two = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # the bytes one and two places before
    one[1:], two[2:] = data[:-1], data[:-2]
    solid = plain | (data > 127)
    for x, y in SPACES_2:
        solid &= ~((one == x) & (data == y))
    for x, y in SPACES_3:
        solid &= ~((two == x) & (one == y))
    begins = np.zeros(n + 1, bool)
    begins[1:-1] = space[1:] & solid[:-1]
    begins[offsets] = True
    begins[1:-1] |= (data[:-1] == 10) & begins[:-2] & (plain | (data == 0xC3))[1:]
    if not pc.any(pc.match_substring(col, "<|")).as_py():
        low = data | 32
        ascii_letter = (low >= 97) & (low <= 122)
        letter = (ascii_letter & (data < 128)) | ((one == 0xC3) & (data != 0x97) & (data != 0xB7))
        mark = plain & ~ascii_letter & ~((data >= 48) & (data <= 57))
        begins[1:-1] |= mark[1:] & letter[:-1]
    begins[-1] = True
    at = np.flatnonzero(begins)
    parts = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return parts, np.searchsorted(at, offsets)


class Encoder:
    """Token ids of whole texts, equal to the byte-level tokenizer's own; each distinct stretch is encoded once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, words: list[str]) -> list[np.ndarray]:
        """The ids of stretches without white space but for a blank before: many to a text, with line feeds between them."""
        lines = self._encode(["\n".join(words[i : i + LINE]) for i in range(0, len(words), LINE)])
        out = []
        for k, ids in enumerate(lines):
            ends = np.flatnonzero(ids == self.feed).tolist()
            out += [ids[a:z] for a, z in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True)]
            if len(out) != min(len(words), (k + 1) * LINE):
                raise ValueError("the tokenizer joins line feeds with what is beside them")
        return out

    def _learn(self, new: list[str]) -> None:
        odd = dict.fromkeys(w for w in new if not EASY.fullmatch(w) or "<|" in w)
        easy = [w for w in new if w not in odd] if odd else new
        got = self._many(easy) + self._encode(list(odd))
        n = np.fromiter(map(len, got), np.int64, len(got))
        k = len(self.known)
        used = int(self.ends[k])
        flat = np.concatenate(got)
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + len(new) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[used : used + len(flat)] = flat
        self.ends[k + 1 : k + 1 + len(new)] = used + np.cumsum(n)
        self.known.update(zip([*easy, *odd], range(k, k + len(new)), strict=True))

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END after each text, and each text's bounds."""
        parts, bounds = stretches(col)
        if len(self.known) > REMEMBERED:
            self.clear()
        d = parts.dictionary_encode()
        names = d.dictionary.to_pylist()
        new = [w for w in names if w not in self.known]
        if new:
            self._learn(new)
        of = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[d.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, np.int64)
        first, n = self.ends[of], self.ends[of + 1] - self.ends[of]
        ends = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(ends[-1]) + np.repeat(first - ends[:-1], n)
        text_ends = ends[bounds]
        out_ends = text_ends + np.arange(len(text_ends))
        out = np.full(out_ends[-1], END, np.uint32)
        out[np.arange(len(take)) + np.repeat(np.arange(len(bounds) - 1), np.diff(text_ends))] = self.ids[take]
        return out, out_ends


def class_sizes(room: int) -> np.ndarray:
    """The tops of the classes, rising: room // k for every k, among them every size up to the root of room."""
    return np.unique(room // np.arange(1, room + 1))


@cache
def cuts(room: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of every rest of 0 to room - 1 tokens, the largest class first, end to end, and their bounds."""
    sizes, found, bounds = class_sizes(room), [], [0]
    for rest in range(room):
        while rest:
            piece = int(sizes[np.searchsorted(sizes, rest, side="right") - 1])
            found.append(piece)
            rest -= piece
        bounds.append(len(found))
    return np.array(found, np.int64), np.array(bounds, np.int64)


class Bins:
    """Fills the bins of one partition.  Between calls it holds the pieces of bins that aren't full: less than one bin a class."""

    NAMES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def __init__(self, part: int, room: int, id_col: str, with_ids: bool):
        self.part, self.room, self.id_col, self.with_ids = part, room, id_col, with_ids
        self.each = room // np.maximum(1, np.arange(room + 1))
        self.made = np.zeros(room + 1, np.int64)
        self.rows = 0
        self.held: tuple | None = None  # id, serial, start, length, doc_tokens, ids

    def _sequence(self, kind, at) -> np.ndarray:
        return np.int64(self.part) << 44 | np.asarray(kind, np.int64) << 32 | at

    def _batch(self, doc: pa.Array, ids: np.ndarray, at, start, length, tokens, seq, offset) -> pa.RecordBatch:
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(at))
        cols = [doc, *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens, seq, offset))]
        if self.with_ids:
            flat = ids[np.arange(length.sum()) + np.repeat(at - np.cumsum(length) + length, length)]
            cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(flat.astype(np.int64))))
        return pa.RecordBatch.from_arrays(cols, [self.id_col, *self.NAMES, *["ids"] * self.with_ids])

    def add(self, doc: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        """The pieces that full bins now take."""
        found, bounds = cuts(self.room)
        size = np.diff(ends)
        full, rest = size // self.room, size % self.room
        n = full + np.diff(bounds)[rest]
        row = np.repeat(np.arange(len(size)), n)
        past = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) - full[row]
        length = np.where(past < 0, self.room, found[np.minimum(bounds[rest[row]] + np.maximum(past, 0), len(found) - 1)])
        at = np.cumsum(length) - length
        start, serial, tokens, doc = at - ends[:-1][row], row + self.rows, size[row], doc.take(pa.array(row))
        self.rows += len(size)
        if self.held:
            d, s, b, k, t, held = self.held
            at = np.concatenate([np.cumsum(k) - k, at + len(held)])
            doc, serial, start, length, tokens, ids = pa.concat_arrays([d, doc]), np.concatenate([s, serial]), np.concatenate([b, start]), np.concatenate([k, length]), np.concatenate([t, tokens]), np.concatenate([held, ids])
        order = np.argsort(length, kind="stable")
        by = length[order]
        rank = np.empty(len(by), np.int64)
        rank[order] = np.arange(len(by)) - np.searchsorted(by, by)
        bins = np.bincount(length, minlength=self.room + 1) // self.each
        bin_ = rank // self.each[length]
        done = bin_ < bins[length]
        seq = self._sequence(length, self.made[length] + bin_)
        self.made += bins
        left = np.flatnonzero(~done)
        ids_left = ids[np.arange(length[left].sum()) + np.repeat(at[left] - np.cumsum(length[left]) + length[left], length[left])]
        self.held = (doc.take(pa.array(left)), serial[left], start[left], length[left], tokens[left], ids_left)
        k = np.flatnonzero(done)
        return self._batch(doc.take(pa.array(k)), ids, at[k], start[k], length[k], tokens[k], seq[k], (rank % self.each[length] * length)[k])

    def close(self) -> pa.RecordBatch | None:
        """The pieces still held, in sequences of room tokens and of powers of two."""
        if not self.held or not len(self.held[1]):
            return None
        doc, serial, start, length, tokens, ids = self.held
        at = np.cumsum(length) - length
        order = np.lexsort((start, serial))
        ids = ids[np.arange(len(ids)) + np.repeat(at[order] - np.cumsum(length[order]) + length[order], length[order])]
        doc, serial, start, length, tokens = doc.take(pa.array(order)), serial[order], start[order], length[order], tokens[order]
        at, total = np.cumsum(length) - length, int(length.sum())
        new = np.ones(len(at), bool)  # pieces that follow each other in their text are one again
        new[1:] = (serial[1:] != serial[:-1]) | (start[1:] != start[:-1] + length[:-1])
        first = np.flatnonzero(new)
        tail = total % self.room
        powers = [1 << k for k in reversed(range(tail.bit_length())) if tail >> k & 1]
        seqs = np.concatenate([np.arange(0, total - tail, self.room), total - tail + np.cumsum([0, *powers])[:-1]]).astype(np.int64)
        begins = np.union1d(at[first], seqs)
        piece = first[np.searchsorted(at[first], begins, side="right") - 1]
        seq = np.searchsorted(seqs, begins, side="right") - 1
        return self._batch(doc.take(pa.array(piece)), ids, begins, start[piece] + begins - at[piece], np.diff(np.append(begins, total)), tokens[piece], self._sequence(0, seq), begins - seqs[seq])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_harmonic(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", room: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Packs every text of df into sequences of at most `room` tokens by harmonic classes.

    Returns for each piece id, start (its text's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset, and
    with_ids, its ids.  A text is its token ids and one END; a null or empty text is END alone.  A sequence is padded to room
    unless its length is a power of two.  Rows that share an id are packed each by itself, null ids too; other columns are
    ignored; an empty table gives an empty result.  Which pieces share a sequence depends on the partitions of df, the number of
    tokens in padding hardly does.  A task holds one slice of text and less than one bin a class.
    """
    path = path or tokenizer_path()

    def run(batches):
        encoder, bins = Encoder(path), Bins(TaskContext.get().partitionId(), room, id_col, with_ids)
        for b, col in slices(batches, text_col, 4 << 20):
            yield bins.add(b.column(b.schema.get_field_index(id_col)), *encoder(col))
        last = bins.close()
        if last is not None:
            yield last

    rows = df.select(id_col, text_col)
    return rows.mapInArrow(tidy(run), f"`{id_col}` {dict(rows.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids)


def op12_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null and empty texts are one token; rows that share an id are packed each by itself; see `pack_harmonic`."""
    return pack_harmonic(table(spark, sf_dir, "documents"))
