"""Collocations: phrases whose words occur together far more often than their parts would by chance.

Frequent phrases are found a length at a time (Park, Chen and Yu's hashing with Apriori pruning).  While phrases of k words are
counted, those of k + 1 words are only hashed into buckets; the buckets that reach the least count make a bitmap which all tasks
get.  A phrase of k + 1 words is then counted exactly only if its bucket is full and both phrases of k words in it are frequent;
these too are known by a bitmap.  Bitmaps have a bounded size whatever the corpus holds, and let a phrase pass too often, never
too seldom: the exact counts decide.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, mix64, slices, table, text_bytes, tidy, tidy_table, word_hashes

MIN_COUNT, MAX_WORDS, FIRST = 100, 5, 2000
#: Bytes that separate pieces and words of a piece: fixed by the task.
PIECES, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Language of rows without one.
NO_LANG = "und"
#: Bits of a bitmap, at least and at most (16 MB), and of the part of it that one row of counts covers.
LEAST_BITS, MOST_BITS, CHUNK_BITS = 16, 27, 15
#: Rows of counts that a task holds before it hands them on, and partitions whose bucket counts are added up first.
HELD, FAN = 400_000, 64
MARK = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts, A-Z lowered: code (index in names), piece, lang (index in langs), own (hashes with lang)."""

    def __init__(self, col: pa.Array, lang: pa.Array):
        data, offsets = text_bytes(pc.ascii_lower(col))
        kind = np.zeros(256, np.uint8)
        kind[list(SPACES)], kind[list(PIECES)] = 1, 2
        kind = kind[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        edge = edge[:-1]
        word = kind == 0
        start = word.copy()
        start[1:] &= ~word[:-1] | edge[1:]
        at = np.flatnonzero(start)
        bounds = np.append(np.cumsum(word)[at] - 1, word.sum()).astype(np.int64)
        flat = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[word]))])
        self.piece = (np.cumsum(kind == 2) + np.cumsum(edge))[at]
        langs = pc.fill_null(lang, NO_LANG).dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[np.searchsorted(offsets, at, side="right") - 1]
        hashes, self.code, self.names = word_hashes(flat)
        salt = word_hashes(self.langs)[0]  # each occurs once, so they are in order
        with np.errstate(over="ignore"):
            self.own = hashes + (mix64(salt)[self.lang] if len(at) else hashes)
        self.key = self.lang * max(1, len(self.names)) + self.code

    def within(self, k: int) -> np.ndarray:
        """Whether k words from here on are in one piece, for all places but the last k - 1."""
        n = max(0, len(self.code) - k + 1)
        return self.piece[:n] == self.piece[k - 1 :]

    def hashes(self, k: int) -> np.ndarray:
        """A hash of the k words from here on, for all places but the last k - 1."""
        n = max(0, len(self.code) - k + 1)
        return mix64(chained([self.own[i : n + i] for i in range(k)]))

    def counts(self, at: np.ndarray, k: int) -> pa.Table:
        """lang, phrase and n of the phrases of k words at these places, told apart by their words, not by a hash."""
        key, many = self.key[at], len(self.langs) * max(1, len(self.names))
        for i in range(1, k):
            key = np.unique(key, return_inverse=True)[1] * many + self.key[at + i]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        first = at[first]
        phrase = self.names.take(pa.array(self.code[first]))
        for i in range(1, k):
            phrase = pc.binary_join_element_wise(phrase, self.names.take(pa.array(self.code[first + i])), pa.scalar(" ", pa.large_string()))
        return pa.table({"lang": self.langs.take(pa.array(self.lang[first])).cast(pa.large_string()), "phrase": phrase, "n": pa.array(n, pa.int64())})


def chained(own: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(own[0]), np.uint64)
    with np.errstate(over="ignore"):
        for x in own:
            h = h * MARK + x
    return h


def places(words: Words, k: int, frequent: np.ndarray | None, buckets: np.ndarray | None) -> np.ndarray:
    """Which places may begin a frequent phrase of k words, by the bitmaps of frequent phrases of k - 1 words and of buckets."""
    ok = words.within(k)
    if frequent is not None:
        shorter = marked(frequent, words.hashes(k - 1))
        ok &= shorter[: len(ok)] & shorter[1 : len(ok) + 1]
    return ok if buckets is None else ok & marked(buckets, words.hashes(k))


def bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = bucket_of(h, (len(bitmap) * 8).bit_length() - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


COUNTS = "lang string, phrase string, n long, chunk int, part int, at binary, times binary"


def _as_counts(t: pa.Table) -> pa.RecordBatch:
    n = t.num_rows
    cols = [t.column(c).combine_chunks().cast(kind) for c, kind in (("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()))]
    return pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], ["lang", "phrase", "n", "chunk", "part", "at", "times"])


class _Buckets:
    """Counts by bucket, none above `enough`: sums of these reach it where the true sums do."""

    def __init__(self, bits: int, enough: int):
        self.bits, self.enough, self.kind = bits, enough, np.min_scalar_type(enough)
        self.at, self.times, self.new = np.zeros(0, np.int64), np.zeros(0, self.kind), []

    def add(self, h: np.ndarray) -> None:
        self.new.append(np.unique(bucket_of(h, self.bits), return_counts=True))
        if sum(len(a) for a, _ in self.new) > max(1 << 20, len(self.at)):
            self._merge()

    def _merge(self) -> None:
        at = np.concatenate([self.at, *(a for a, _ in self.new)])
        times = np.concatenate([self.times.astype(np.int64), *(n for _, n in self.new)])
        self.at, of = np.unique(at, return_inverse=True)
        self.times = np.minimum(np.bincount(of, times, len(self.at)), self.enough).astype(self.kind)
        self.new = []

    def batch(self) -> pa.RecordBatch:
        self._merge()
        chunk = self.at >> CHUNK_BITS
        some, first = np.unique(chunk, return_index=True)
        cut_ = np.append(first, len(chunk))
        low = (self.at & ((1 << CHUNK_BITS) - 1)).astype(np.uint16)
        n, part = len(some), TaskContext.get().partitionId() // FAN
        parts = [pa.array([x[a:z].tobytes() for a, z in zip(cut_[:-1], cut_[1:], strict=True)], pa.binary()) for x in (low, self.times)]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(some, pa.int32()), pa.array(np.full(n, part), pa.int32()), *parts], ["lang", "phrase", "n", "chunk", "part", "at", "times"])


def bitmap(rows: DataFrame, bits: int, enough: int) -> np.ndarray:
    """The bitmap of the buckets that reach `enough` in rows of bucket counts (chunk, part, at, times).

    The counts of FAN partitions at a time are added up first, so no task reads those of all partitions.
    """
    kind, size = np.min_scalar_type(enough), min(1 << CHUNK_BITS, 1 << bits)

    def summed(t: pa.Table) -> np.ndarray:
        total = np.zeros(size, np.int64)
        for at, times in zip(t.column("at").to_pylist(), t.column("times").to_pylist(), strict=True):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(times, kind)
        return np.minimum(total, enough)

    def add(t: pa.Table) -> pa.Table:
        total = summed(t)
        at = np.flatnonzero(total)
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "at": pa.array([at.astype(np.uint16).tobytes()], pa.binary()), "times": pa.array([total[at].astype(kind).tobytes()], pa.binary())})

    def full(t: pa.Table) -> pa.Table:
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "map": pa.array([np.packbits(summed(t) >= enough, bitorder="little").tobytes()], pa.binary())})

    some = rows.select("chunk", "part", "at", "times").groupBy("chunk", "part").applyInArrow(tidy_table(add), "chunk int, at binary, times binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in some.groupBy("chunk").applyInArrow(tidy_table(full), "chunk int, map binary").toLocalIterator():
        out[r.chunk * size // 8 : (r.chunk + 1) * size // 8] = np.frombuffer(r.map, np.uint8)
    return out


def counted(df: DataFrame, k: int, enough: int, bits: int | None, frequent: np.ndarray | None = None, buckets: np.ndarray | None = None) -> DataFrame:
    """Partial counts of phrases of k words (lang, phrase, n), and with bits, of the buckets of those of k + 1 (chunk, part, at, times)."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast((frequent, buckets))

    def run(batches):
        tables, rows, next_ = [], 0, _Buckets(bits, enough) if bits else None
        for b, col in slices(batches, "text", 2 << 20):
            words = Words(col, b.column(b.schema.get_field_index("lang")))
            if len(words.code) < k:
                continue
            ok = places(words, k, *sent.value)
            tables.append(words.counts(np.flatnonzero(ok), k))
            rows += tables[-1].num_rows
            if next_:
                both = words.within(k + 1)
                next_.add(words.hashes(k + 1)[both & ok[: len(both)] & ok[1 : len(both) + 1]])
            if rows > HELD:
                one = pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])
                tables, rows = [one], one.num_rows
                if rows > HELD // 2:
                    yield _as_counts(one)
                    tables, rows = [], 0
        if tables:
            yield _as_counts(pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"]))
        if next_:
            yield next_.batch()

    return df.mapInArrow(tidy(run), COUNTS)


def phrase_bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the hashes of these phrases (lang, phrase)."""

    def run(batches):
        have = _Buckets(bits, 1)
        for b in batches:
            salt = mix64(word_hashes(b.column(b.schema.get_field_index("lang")).cast(pa.large_string()))[0])
            parts = pc.split_pattern(b.column(b.schema.get_field_index("phrase")).cast(pa.large_string()), " ")
            ends = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            own = word_hashes(parts.flatten())[0]
            k = ends[1] - ends[0] if len(ends) > 1 else 0  # all phrases are as long
            with np.errstate(over="ignore"):
                own = own.reshape(-1, k) + salt[:, None] if k else own.reshape(0, 1)
            have.add(mix64(chained(list(own.T))))
        yield have.batch()

    return bitmap(phrases.select("lang", "phrase").mapInArrow(tidy(run), COUNTS), bits, 1)


def _bits(n: float) -> int:
    """Bits of a bitmap's size for n buckets, within bounds."""
    return min(MOST_BITS, max(LEAST_BITS, int(n).bit_length()))


def frequent_phrases(df: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """lang, words, phrase and n of all phrases of 1 to max_words words with min_count occurrences or more; words of each lang.

    Both are exact.  Occurrences overlap; words are parted by spaces and tabs, and none passes a mark that parts pieces.
    """
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _bits(size / min_count)  # some six bytes a word: one and a third buckets for each min_count / 8 words
    found, totals, frequent, buckets = [], None, None, None
    for k in range(1, max_words + 1):
        got = cut(counted(rows, k, min_count, bits if k < max_words else None, frequent, buckets))
        counts = got.filter("lang IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if k == 1:
            counts = cut(counts)
            totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
        often = cut(counts.filter(F.col("n") >= min_count).select("lang", F.lit(k).alias("words"), "phrase", "n"))
        found.append(often)
        n = often.count()
        if k == max_words or not n:
            break
        frequent, buckets = phrase_bitmap(often, _bits(16 * n)), bitmap(got.filter("chunk IS NOT NULL"), bits, min_count)
    return reduce(DataFrame.union, found), totals


def collocations(df: DataFrame, first: int = FIRST, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """The `first` phrases of 2 to max_words words of each lang by score: lang, rank, phrase, a, l, r, n, score.

    a: occurrences of the phrase, min_count at least; n: all words of the lang.  The phrase is cut in two where the score
    floor(1000 * a * n / (l * r)) is lowest (ties: the first such cut), l and r being occurrences of the parts.  A phrase goes if
    a longer frequent one holds it and is as frequent.  Order: score, then a, both falling, then phrase by bytes of UTF-8.
    Null lang is 'und'; null and empty texts have no words; texts that repeat count each time; other columns are ignored; an empty
    table gives an empty result.  Scores are exact while 1000 * a * n has at most 38 digits and fails beyond.
    """
    frequent, totals = frequent_phrases(df, lang_col, text_col, min_count, max_words)
    return ranked(cut(frequent), totals, first)


def ranked(all_: DataFrame, totals: DataFrame, first: int) -> DataFrame:
    """What `collocations` returns, of frequent phrases (lang, words, phrase, n) and the words of each lang (lang, total)."""
    parts = F.split("phrase", " ")
    many = all_.filter("words > 1")
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "words", "phrase", F.col("n").alias("a"), "k", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    of = all_.select("lang", "phrase", "n")
    cuts = cuts.join(of.toDF("lang", "left", "l"), ["lang", "left"]).join(of.toDF("lang", "right", "r"), ["lang", "right"]).join(totals, "lang")

    def whole(c):
        return F.col(c).cast("decimal(19,0)")

    above = (whole("a") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(23,0)").cast("decimal(38,0)") * whole("total")
    below = (whole("l") * whole("r")).cast("decimal(38,0)")
    scored = cuts.withColumn("above", above.cast("decimal(38,0)")).withColumn("below", below).withColumn("score", F.expr("above div below"))
    best = scored.groupBy("lang", "words", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the most occurrences of any longer phrase that holds a phrase
    inner = many.filter("words > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    inner = inner.select("lang", F.array_join(F.slice(parts, F.col("i"), F.col("m")), " ").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("held"))
    left = best.join(inner, ["lang", "phrase"], "left").filter("held IS NULL OR held < a").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the first of each part of a lang before those of the lang, so that no task sorts all its phrases
    dealt = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(int(all_.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    some = dealt.withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("at") <= first)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; nulls, ties and repeats as in `collocations`."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4), (5)) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS s FROM f WHERE f >= 100),
cuts AS (SELECT lang, k, phrase, f, s, unnest(range(1, k)) AS c FROM often WHERE k > 1),
scored AS (
  SELECT x.lang, x.k, x.phrase, x.f AS a, x.c, a.f AS l, b.f AS r, n.n,
         ((1000::HUGEINT * x.f * n.n) // (a.f::HUGEINT * b.f))::BIGINT AS score
  FROM cuts x
  JOIN often a ON a.lang = x.lang AND a.phrase = array_to_string(x.s[1:x.c], ' ')
  JOIN often b ON b.lang = x.lang AND b.phrase = array_to_string(x.s[x.c + 1:], ' ')
  JOIN n ON n.lang = x.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, array_to_string(s[i:i + m - 1], ' ') AS phrase, max(f) AS held
  FROM (SELECT lang, k, s, f, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, k, s, f, unnest(range(2, k)) AS m FROM often WHERE k > 2))
  GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.held IS NULL OR 100 * i.held < 100 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept)
WHERE rank <= 2000
"""
