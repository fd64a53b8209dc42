"""Language-model scoring with a hashed maximum-entropy model.

Frequent words are symbols of their own, other words are symbols by shape (letters, length, ending).  A class-factored
softmax over hashed bigram, skip and trigram features gives each symbol's probability; a word of a shape has the share
of its count among the shape's words.  Training needs the counts of symbol triples only, which the whole training text
gives; each update sums the expected feature counts of all partitions.  Word counts are exact: counts are added up in
each task before they meet.  The counts of the most frequent words, a bounded number, are known to all tasks; other words of
documents are dealt by hash to shards, where they meet their counts, and sums go back to the documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import cut, is_remainder, mix64, slices, summed, sums, table, text_bytes, tidy, tidy_table, words

#: Words with a symbol (one is the end of a text), and members of a class.
FREQUENT, MEMBERS = 1024, 64
#: Bytes of a word with a symbol, at most.
LONGEST = 64
#: Words whose counts all tasks know: 24 bytes each.
KNOWN = 1 << 18
#: Rows of hashed trigram features and of the hashed features within classes.
TRIGRAMS, WITHIN = 4096, 4096
#: Updates, their size, and the pseudo-count that holds rare features back.
STEPS, RATE, DAMP = 6, 0.5, 4.0
#: Bytes of text that are taken at once.
SLICE = 4 << 20
#: Bytes of words that one shard looks up, about, and of a document's word among them.
SHARD_BYTES, PAIR = 16 << 20, 22
#: Triples that one task takes in each update.
TRIPLES = 500_000
ENDINGS = (b".,;:!?", b"\"')]}%&*$#|-")
#: Letters beyond ASCII or not, three endings, three lengths, five groups of first bytes.
GROUPS = 5
SHAPES = 2 * 3 * 3 * GROUPS


def shapes(names: pa.Array) -> np.ndarray:
    """The shape of each word, from 0 to SHAPES - 1."""
    data, at = text_bytes(names.cast(pa.large_string()))
    size = np.diff(at)
    wide = sums(data >= 128, at) > 0
    first, last = data[at[:-1]].astype(np.uint64), data[at[1:] - 1]
    ending = np.select([np.isin(last, list(e)) for e in ENDINGS], [1, 2], 0)
    length = np.digitize(size, [5, 9])
    group = (mix64(first) % np.uint64(GROUPS)).astype(np.int64)
    return ((wide * 3 + ending) * 3 + length) * GROUPS + group


@dataclass
class Vocabulary:
    words: list[str]  # frequent words, symbols 1 and on; 0 is the end

    def __post_init__(self):
        self.index = {w: i + 1 for i, w in enumerate(self.words)}
        self.frequent = len(self.words) + 1
        self.symbols = self.frequent + SHAPES
        self.start = self.symbols  # before the first word

    def encode(self, col: pa.Array) -> Tokens:
        flat, bounds = words(col)
        d = flat.dictionary_encode()
        codes, names = d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary
        own = np.fromiter((self.index.get(w, 0) for w in names.to_pylist()), np.int64, len(names))
        if len(names):
            own = np.where(own > 0, own, self.frequent + shapes(names))
        n = len(bounds) - 1
        ends = bounds + np.arange(n + 1)
        all_ = np.zeros(ends[-1], np.int64)
        doc = np.repeat(np.arange(n), np.diff(bounds))
        all_[np.arange(len(codes)) + doc] = own[codes]
        one, two = np.roll(all_, 1), np.roll(all_, 2)
        one[ends[:-1]] = two[ends[:-1]] = self.start
        second = ends[:-1][np.diff(ends) > 1] + 1
        two[second] = self.start
        return Tokens(all_, one, two, ends, names, own, codes, bounds, doc)


@dataclass
class Tokens:
    symbol: np.ndarray  # of all tokens, an end after each text
    before: np.ndarray
    skipped: np.ndarray
    ends: np.ndarray  # bounds of the texts among all tokens
    names: pa.Array = None  # distinct words
    own: np.ndarray = None  # and their symbols
    codes: np.ndarray = None  # of the words alone: the index among names
    bounds: np.ndarray = None  # bounds of the texts among the words
    doc: np.ndarray = None


@dataclass
class Model:
    vocabulary: Vocabulary
    cls: np.ndarray
    member: np.ndarray
    first: np.ndarray = field(default=None)  # weights of classes, a row a feature
    within: np.ndarray = field(default=None)
    bias: np.ndarray = field(default=None)

    def features(self, two: np.ndarray, one: np.ndarray) -> list[np.ndarray]:
        n = self.vocabulary.symbols + 1
        tri = (mix64(two * n + one) % np.uint64(TRIGRAMS)).astype(np.int64)
        return [np.zeros(len(one), np.int64), 1 + one, 1 + n + two, 1 + 2 * n + tri]

    def inner(self, cls: np.ndarray, two: np.ndarray, one: np.ndarray) -> list[np.ndarray]:
        n = self.vocabulary.symbols + 1
        return [(mix64((cls * n + x) * 2 + k) % np.uint64(WITHIN)).astype(np.int64) for k, x in enumerate((one, two))]

    def class_logs(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        return _log_softmax(sum(self.first[f] for f in self.features(two, one)))

    def member_logs(self, cls: np.ndarray, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        return _log_softmax(self.bias[cls] + sum(self.within[f] for f in self.inner(cls, two, one)))

    def split(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.vocabulary.symbols + 1
        return key // (n * n), key // n % n, key % n

    def logs(self, t: Tokens) -> np.ndarray:
        """log10 of each token's symbol; each distinct context and class is computed once."""
        n = self.vocabulary.symbols + 1
        key, of = np.unique((t.skipped * n + t.before) * n + t.symbol, return_inverse=True)
        two, one, sym = self.split(key)
        ctx, at = np.unique(key // n, return_inverse=True)
        out = self.class_logs(ctx // n, ctx % n)[at, self.cls[sym]].astype(np.float64)
        pair, where = np.unique(at * len(self.bias) + self.cls[sym], return_inverse=True)
        c, cls = ctx[pair // len(self.bias)], pair % len(self.bias)
        order = np.argsort(where, kind="stable")
        lo = np.searchsorted(where[order], np.arange(len(pair) + 1))
        for a in range(0, len(pair), 16_384):
            z = min(len(pair), a + 16_384)
            logs = self.member_logs(cls[a:z], c[a:z] // n, c[a:z] % n)
            rows = order[lo[a] : lo[z]]
            out[rows] += logs[where[rows] - a, self.member[sym[rows]]]
        return (out / np.log(10))[of]


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def _scatter(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """out[rows] += values, also where rows repeat."""
    if len(rows):
        order = np.argsort(rows, kind="stable")
        at = np.flatnonzero(np.append(True, rows[order][1:] != rows[order][:-1]))
        out[rows[order][at]] += np.add.reduceat(values[order], at, axis=0)


# --- vocabulary and counts ---------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word and its count n over all texts."""

    def run(batches):
        for _, col in slices(batches, text, SLICE):
            d = words(col)[0].dictionary_encode()
            n = np.bincount(d.indices.to_numpy(zero_copy_only=False), minlength=len(d.dictionary))
            for i in range(0, len(n), 1 << 16):
                yield pa.RecordBatch.from_arrays([d.dictionary[i : i + (1 << 16)].cast(pa.string()), pa.array(n[i : i + (1 << 16)])], ["word", "n"])

    return docs.select(text).mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, n: int = FREQUENT - 1) -> list[str]:
    """The words with the highest counts, ties by word; words of more than LONGEST bytes keep to their shapes."""
    return [r.word for r in counts.filter(F.octet_length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(n).collect()]


def digests(names: pa.Array) -> np.ndarray:
    """128-bit digests of words, as two columns of 64 bits."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, names.cast(pa.large_binary()).to_pylist())), np.uint64).reshape(-1, 2)


class Table:
    """Counts by digest; the keys are sorted."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        self.a, self.b, self.n = (np.ascontiguousarray(x) for x in (keys[order, 0], keys[order, 1], n[order]))
        # keys that share their first 64 bits lie side by side
        self.run = int(np.diff(np.flatnonzero(np.concatenate([[True], self.a[1:] != self.a[:-1], [True]]))).max()) if len(n) else 0

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key, -1 for one that isn't there."""
        out = np.full(len(keys), -1, np.int64)
        at = np.searchsorted(self.a, keys[:, 0])
        for k in range(self.run):
            p = np.minimum(at + k, len(self.a) - 1)
            hit = (self.a[p] == keys[:, 0]) & (self.b[p] == keys[:, 1])
            out[hit] = self.n[p[hit]]
        return out


def other_words(counts: DataFrame, v: Vocabulary) -> DataFrame:
    """a, b (the digest), shape and n of the words without a symbol."""

    def run(batches):
        for t in batches:
            names = t.column("word").cast(pa.large_string())
            rare = np.fromiter((w not in v.index for w in names.to_pylist()), bool, len(names))
            names, n = names.filter(pa.array(rare)), t.column("n").to_numpy()[rare]
            keys = digests(names).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(shapes(names) if len(n) else n), pa.array(n)], ["a", "b", "shape", "n"])

    return counts.mapInArrow(tidy(run), "a long, b long, shape long, n long")


def most_frequent(others: DataFrame, known: int) -> tuple[Table, int]:
    """Counts of the most frequent of these words, `known` at most, and the most that any other word can have.

    A histogram of counts gives the least count that is let in, so that no task sorts words or gets all of them.
    """
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(1024 + 64 * F.log2(F.col("n") / 1024))).cast("long")
    bars = sorted(((r.step, r["count"], r.most) for r in others.groupBy(step.alias("step")).agg(F.count("*").alias("count"), F.max("n").alias("most")).collect()), reverse=True)
    total, least, most = 0, 1 << 60, 0
    for at, count, high in bars:
        total += count
        if total > known:
            most = high
            break
        least = at
    got = others.filter(step >= least).select("a", "b", "n").toArrow()
    return Table(np.stack([got.column(c).to_numpy().view(np.uint64) for c in "ab"], 1), got.column("n").to_numpy()), most


def shape_counts(others: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words of each shape, counted with and without their repeats."""

    def add(batches):
        out = np.zeros(2 * SHAPES)
        for t in batches:
            shape = t.column("shape").to_numpy()
            out += np.concatenate([np.bincount(shape, t.column("n").to_numpy(), minlength=SHAPES), np.bincount(shape, minlength=SHAPES)])
        return out

    got = summed(others, add)
    return (got[:SHAPES], got[SHAPES:]) if len(got) else (np.zeros(SHAPES), np.zeros(SHAPES))


def triple_counts(docs: DataFrame, v: Vocabulary, text: str = "text") -> DataFrame:
    """key (two symbols before, symbol before, symbol) and its count n over all texts."""
    s = v.symbols + 1

    def run(batches):
        keys, counts, held = [], [], 0

        def flush():
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
            for i in range(0, len(key), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 200_000]), pa.array(n[i : i + 200_000])], ["key", "n"])

        for _, col in slices(batches, text, SLICE):
            t = v.encode(col)
            key, n = np.unique((t.skipped * s + t.before) * s + t.symbol, return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > 1_500_000:
                yield from flush()
                keys, counts, held = [], [], 0
        if keys:
            yield from flush()

    return docs.select(text).mapInArrow(tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


# --- training ----------------------------------------------------------------------------------------------------


def _pairs(counts: DataFrame, which: str, s: int) -> np.ndarray:
    """Counts of (symbol at a place before, symbol) as a matrix; its size depends on the vocabulary alone."""
    place = F.floor(F.col("key") / (s if which == "before" else s * s)).cast("long") % s
    got = counts.groupBy(place.alias("a"), (F.col("key") % s).alias("b")).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((s, s))
    out[got.column("a").to_numpy(), got.column("b").to_numpy()] = got.column("n").to_numpy()
    return out


def classes(pairs: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Class and member of each symbol: frequent words that follow like symbols are together; shapes come last."""
    seen = pairs[: v.symbols, : v.frequent]
    share = np.log1p(seen * 1000 / np.maximum(seen.sum(0, keepdims=True), 1))
    share -= share.mean(1, keepdims=True)
    order = np.argsort(np.linalg.svd(share, full_matrices=False)[2][0], kind="stable") if seen.sum() else np.arange(v.frequent)
    cls, member = np.zeros(v.symbols + 1, np.int64), np.zeros(v.symbols + 1, np.int64)
    cls[order], member[order] = np.arange(v.frequent) // MEMBERS, np.arange(v.frequent) % MEMBERS
    last = cls.max() + 1
    k = np.arange(SHAPES)
    cls[v.frequent : v.symbols], member[v.frequent : v.symbols] = last + k // MEMBERS, k % MEMBERS
    return cls, member


def _start(model: Model, before: np.ndarray, skipped: np.ndarray) -> None:
    """Weights from smoothed log ratios of pair counts."""
    v = model.vocabulary
    n = v.symbols + 1
    n_cls = int(model.cls.max()) + 1
    total = before.sum(0)[: v.symbols]
    by_class = np.bincount(model.cls[: v.symbols], total, minlength=n_cls)
    prior = (by_class + 1) / (by_class + 1).sum()
    model.first = np.zeros((1 + 2 * n + TRIGRAMS, n_cls), np.float32)
    model.first[0] = np.log(prior)
    model.bias = np.full((n_cls, MEMBERS), -30.0, np.float32)
    size = np.bincount(model.cls[: v.symbols], total, minlength=n_cls)
    room = np.bincount(model.cls[: v.symbols], minlength=n_cls)
    p = (total + 0.5) / (size + 0.5 * room)[model.cls[: v.symbols]]
    model.bias[model.cls[: v.symbols], model.member[: v.symbols]] = np.log(p)
    model.within = np.zeros((WITHIN, MEMBERS), np.float32)
    for k, (pairs, part) in enumerate(((before, 0.6), (skipped, 0.4))):
        c = np.zeros((n, n_cls))
        for j in range(n_cls):
            c[:, j] = pairs[:, : v.symbols][:, model.cls[: v.symbols] == j].sum(1)
        model.first[1 + k * n : 1 + (k + 1) * n] = part * np.log((c + 20 * prior) / (c.sum(1, keepdims=True) + 20) / prior)
        a, b = np.nonzero(pairs[:, : v.symbols])
        row = model.inner(model.cls[b], a, a)[k]
        seen, base = np.zeros((WITHIN, MEMBERS)), np.zeros((WITHIN, MEMBERS))
        np.add.at(seen, (row, model.member[b]), pairs[a, b])
        own = np.unique(np.stack([row, model.cls[b]]), axis=1)
        np.add.at(base, own[0], np.exp(model.bias[own[1]]))
        base /= np.maximum(base.sum(1, keepdims=True), 1e-9)
        ratio = (seen + 20 * base + 1e-6) / (seen.sum(1, keepdims=True) + 20) / (base + 1e-6)
        model.within += (part * np.log(ratio) * (seen.sum(1, keepdims=True) > 0)).astype(np.float32)


def _expected(model: Model, key: np.ndarray, n: np.ndarray, seen: bool) -> list[np.ndarray]:
    """What the model expects (or, if seen, what was counted) of each feature over the triples."""
    s = model.vocabulary.symbols + 1
    out = [np.zeros(model.first.shape), np.zeros(model.within.shape), np.zeros(model.bias.shape)]
    two, one, sym = model.split(key)
    cls, n_cls = model.cls[sym], len(model.bias)
    ctx, at = np.unique(key // s, return_inverse=True)
    pair, where = np.unique(at * n_cls + cls, return_inverse=True)
    if seen:
        mass = np.bincount(at * n_cls + cls, n, minlength=len(ctx) * n_cls).reshape(-1, n_cls)
    else:
        mass = np.exp(model.class_logs(ctx // s, ctx % s)) * np.bincount(at, n)[:, None]
    for f in model.features(ctx // s, ctx % s):
        _scatter(out[0], f, mass)
    own, total = pair % n_cls, np.bincount(where, n)
    c = ctx[pair // n_cls]
    for a in range(0, len(pair), 16_384):
        z = min(len(pair), a + 16_384)
        if seen:
            mine = (where >= a) & (where < z)
            mass = np.bincount((where[mine] - a) * MEMBERS + model.member[sym[mine]], n[mine], minlength=(z - a) * MEMBERS).reshape(-1, MEMBERS)
        else:
            mass = np.exp(model.member_logs(own[a:z], c[a:z] // s, c[a:z] % s)) * total[a:z, None].astype(np.float32)
        _scatter(out[2], own[a:z], mass)
        for f in model.inner(own[a:z], c[a:z] // s, c[a:z] % s):
            _scatter(out[1], f, mass)
    return out


def _summed(counts: DataFrame, model: Model, seen: bool) -> list[np.ndarray]:
    """_expected over all partitions."""
    shapes_ = [model.first.shape, model.within.shape, model.bias.shape]

    def expected(batches):
        total, held, rows = np.zeros(sum(int(np.prod(s)) for s in shapes_)), [], 0

        def add():
            key, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("key", "n"))
            return np.concatenate([x.ravel() for x in _expected(model, key, n, seen)])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 500_000:
                total += add()
                held, rows = [], 0
        return total + add() if rows else total

    flat, out = summed(counts, expected, np.float32), []
    for shape in shapes_:
        out.append(flat[: np.prod(shape)].reshape(shape))
        flat = flat[np.prod(shape) :]
    return out


def train(docs: DataFrame, text: str = "text", steps: int = STEPS, words_: DataFrame | None = None) -> tuple[Model, np.ndarray]:
    """A model of all texts of docs (null: empty), and the count of each symbol in them.  words_: their word_counts."""
    v = Vocabulary(frequent_words(cut(word_counts(docs, text)) if words_ is None else words_))
    s = v.symbols + 1
    counts = triple_counts(docs, v, text)
    counts = cut(counts.repartition(F.floor(F.col("key") / s)))  # all symbols after one context are together
    counts = counts.coalesce(max(8, counts.count() // TRIPLES))  # each task sends all weights' sums: not more tasks than it takes
    before, skipped = _pairs(counts, "before", s), _pairs(counts, "skipped", s)
    cls, member = classes(before, v)
    model = Model(v, cls, member)
    _start(model, before, skipped)
    if before.sum():
        seen = _summed(counts, model, True)
        for _ in range(steps):
            for name, have, want in zip(("first", "within", "bias"), _summed(counts, model, False), seen, strict=True):
                w = getattr(model, name)
                setattr(model, name, (w + RATE * np.clip((want - have) / (np.maximum(have, want) + DAMP), -1, 1)).astype(np.float32))
    return model, before.sum(0)[: v.symbols].astype(np.int64)


# --- scoring -----------------------------------------------------------------------------------------------------


FIELDS = ["shard", "kind", "slice", "a", "b", "c"]
SCHEMA = "shard long, kind int, slice long, a binary, b binary, c binary"
SCORED = "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
#: Kinds of rows that meet in shards: words of documents, counts of words, and a slice's own rows.
WORDS, COUNTS, OWN = 0, 1, 2


def short(pieces):
    """The same slices, none with over 65,536 rows."""
    for b, col in pieces:
        for at in range(0, b.num_rows, 1 << 16):
            yield b.slice(at, 1 << 16), col.slice(at, 1 << 16)


def _rows(shard, kind, slice_, *cols: list) -> pa.RecordBatch:
    n = len(shard)
    given = [pa.array(c, pa.binary()) for c in cols] + [pa.nulls(n, pa.binary())] * (3 - len(cols))
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([slice_] * n, pa.int64()), *given], FIELDS)


def _dealt(shard: np.ndarray, kind: int, slice_: int, *cols: np.ndarray) -> pa.RecordBatch:
    """A row for each shard that gets something of the columns."""
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.diff(shard[order], prepend=-1))
    ends = np.append(at, len(shard))
    cols = [x[order] for x in cols]
    return _rows(shard[order][at], kind, slice_, *[[x[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)] for x in cols])


def _sizes(docs: DataFrame, others: DataFrame, least: int) -> tuple[int, int]:
    """Shards for words that not all tasks know, and copies of each shard: no word of documents fills more than a shard.

    A word that isn't among the known ones has at most `least` occurrences; texts that weren't learned from may have as many
    again for their share of the bytes.
    """
    rest = others.agg(F.sum("n").alias("n"), F.count("*").alias("words")).first()
    size = docs.agg(F.sum(F.octet_length("text")).alias("all"), F.sum(F.when(~F.col("held"), F.octet_length("text"))).alias("own")).first()
    over = (size["all"] or 0) / max(1, size["own"] or 0)
    bytes_ = min((size["all"] or 0) * PAIR / 2, ((rest["n"] or 0) + (rest["words"] or 0)) * over * PAIR)
    return max(12, int(bytes_ // SHARD_BYTES)), 1 + int(min(least * over, size["all"] or 0) * PAIR // SHARD_BYTES)


def score(docs: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN) -> DataFrame:
    """Scores every text of docs under a model of the texts of the rows where learn_from (a condition) holds.

    Returns id, held_out (learn_from doesn't hold), n_tokens (words and one end), n_known (tokens that occur in the
    training texts), train_tokens, base_score (add-one unigrams) and score, both log10 of the text's probability.  A
    word that doesn't occur in the training texts counts as one of its shape, as base_score counts all as one.  A null
    or empty text is its end alone.  Rows that share an id are scored and learned from each by itself.  Without
    training texts both scores are those of no counts at all.  Other columns are ignored.  How rows lie in partitions
    changes score only by rounding.  known: how many words' counts all tasks hold; it doesn't change results.
    """
    held = ~F.coalesce(learn_from, F.lit(False))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    learned = rows.filter(~F.col("held"))
    counts = cut(word_counts(learned))
    model, symbols = train(learned, words_=counts)
    v = model.vocabulary
    others = cut(other_words(counts, v))
    n_of, kinds_of = shape_counts(others)
    train_tokens, types = int(symbols.sum()), int((symbols[: v.frequent] > 0).sum() + kinds_of.sum())
    base_total, shape_total, log_count = np.log10(train_tokens + types + 1.0), np.log10(n_of + kinds_of + 1.0), np.log10(symbols + 1.0)
    held_by_all, least = most_frequent(others, known)
    every = len(held_by_all.n) >= kinds_of.sum()  # then a word that isn't there doesn't occur at all

    def own_rows(b: pa.RecordBatch, col: pa.Array) -> tuple[pa.Table, Tokens, np.ndarray, np.ndarray]:
        """The slice's rows as far as they are known here, and the words to look up with their digests."""
        t = v.encode(col)
        other = np.flatnonzero(t.own >= v.frequent)
        keys = digests(t.names.take(pa.array(other)))
        n = symbols[np.minimum(t.own, v.frequent - 1)].astype(np.float64)
        n[other] = held_by_all(keys)
        logs, is_other = np.log10(np.maximum(n, 0) + 1), t.own >= v.frequent
        tokens = np.diff(t.ends)
        base = sums(logs[t.codes], t.bounds) + log_count[0] - tokens * base_total
        share = np.where(is_other, logs - shape_total[np.maximum(t.own - v.frequent, 0)], 0.0)
        own = sums(model.logs(t), t.ends) + sums(share[t.codes], t.bounds)
        seen = sums((n > 0)[t.codes], t.bounds) + int(symbols[0] > 0)
        out = pa.table({"id": b.column("id").cast(pa.string()), "held_out": b.column("held"), "n_tokens": tokens, "n_known": seen, "base_score": base, "score": own})
        lost = n[other] < 0
        return out, t, other[lost], keys[lost]

    if every:

        def finished(batches):
            for b, col in short(slices(batches, "text", SLICE)):
                yield from own_rows(b, col)[0].to_batches()

        return _named(rows.mapInArrow(tidy(finished), SCORED), docs, id_col, train_tokens)

    shards, copies = _sizes(rows, others, least)

    def emit(batches):
        part, number = TaskContext.get().partitionId(), 0
        for b, col in short(slices(batches, "text", SLICE)):
            own, t, other, keys = own_rows(b, col)
            slice_ = (part << 24) + number
            number += 1
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as w:
                w.write_table(own)
            yield _rows([slice_ % shards * copies], OWN, slice_, [sink.getvalue().to_pybytes()])
            if len(other):
                index = np.full(len(t.names), -1)
                index[other] = np.arange(len(other))
                word = index[t.codes]
                pair, times = np.unique(t.doc[word >= 0] * len(other) + word[word >= 0], return_counts=True)
                doc, word = (pair // len(other)).astype(np.uint16), pair % len(other)
                shard = (keys[word, 0] % np.uint64(shards)).astype(np.int64) * copies + slice_ % copies
                yield _dealt(shard, WORDS, slice_, keys[word], doc, times.astype(np.uint32))

    def deal(batches):
        for b in batches:
            keys = np.stack([b.column(c).to_numpy().view(np.uint64) for c in "ab"], 1)
            rare = held_by_all(keys) < 0
            keys, n = keys[rare], b.column("n").to_numpy()[rare]
            for k in range(copies if len(n) else 0):
                yield _dealt((keys[:, 0] % np.uint64(shards)).astype(np.int64) * copies + k, COUNTS, -1, keys, n)

    def look_up(t: pa.Table) -> pa.Table:
        """Returns to each slice the sums that its documents need of the shard's words."""
        kind = t.column("kind").to_numpy()
        own, counts, t = (t.filter(pa.array(kind == k)) for k in (OWN, COUNTS, WORDS))
        keys, n = (np.frombuffer(b"".join(counts.column(c).to_pylist()), k) for c, k in (("a", np.uint64), ("b", np.int64)))
        shard = Table(keys.reshape(-1, 2), n)
        out = []
        for slice_, a, b, c in zip(*(t.column(x).to_pylist() for x in ("slice", "a", "b", "c")), strict=True):
            n = np.maximum(shard(np.frombuffer(a, np.uint64).reshape(-1, 2)), 0)
            if n.any():
                docs_, of = np.unique(np.frombuffer(b, np.uint16), return_inverse=True)
                times = np.frombuffer(c, np.uint32)
                out.append(_rows([0], WORDS, slice_, [docs_.tobytes()], [np.bincount(of, times * np.log10(n + 1)).tobytes()], [np.bincount(of, times * (n > 0)).astype(np.uint32).tobytes()]))
        return pa.concat_tables([own, pa.Table.from_batches(out, own.schema)]) if out else own

    def finish(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        own, t = (t.filter(pa.array(kind == k)) for k in (OWN, WORDS))
        m = pa.ipc.open_stream(own.column("a")[0].as_buffer()).read_all()
        logs, seen = np.zeros(m.num_rows), m.column("n_known").to_numpy().copy()
        for a, b, c in zip(*(t.column(x).to_pylist() for x in "abc"), strict=True):
            at = np.frombuffer(a, np.uint16)
            logs[at] += np.frombuffer(b)
            seen[at] += np.frombuffer(c, np.uint32)
        for name, more in (("n_known", seen), ("base_score", m.column("base_score").to_numpy() + logs), ("score", m.column("score").to_numpy() + logs)):
            m = m.set_column(m.schema.get_field_index(name), name, pa.array(more))
        return m

    sent = rows.mapInArrow(tidy(emit), SCHEMA).unionByName(others.mapInArrow(tidy(deal), SCHEMA))
    met = cut(sent.groupBy("shard").applyInArrow(tidy_table(look_up), SCHEMA))
    return _named(met.groupBy("slice").applyInArrow(tidy_table(finish), SCORED), docs, id_col, train_tokens)


def _named(scored: DataFrame, docs: DataFrame, id_col: str, train_tokens: int) -> DataFrame:
    return scored.select(F.col("id").cast(dict(docs.dtypes)[id_col]).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those whose crc32 modulo 7 is 2 are held out.  Nulls, repeats and empty texts as in `score`."""
    held = is_remainder(F.col("doc_id"), 7, 2)
    return score(table(spark, sf_dir, "documents"), ~held)
