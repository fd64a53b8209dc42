"""Groups of spelling variants: words one edit apart, found by an even-partition pigeonhole join.

A word of l letters is indexed under its two halves, each with l.  One edit leaves one half as it is, so a word finds its near
words of the same length under its own halves, and those one letter shorter under the halves that it has without the letter: the
first at its beginning, the second one place further on.  Words that meet are tested for one edit.  A half that very many words
share is no good as a key: there the rest of the word, in which the edit must be, is halved again, until few words meet or one
letter is left, which as many words share at most as there are letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import cut, slices, table, tidy, tidy_table

#: Fixed by the task: letters of a run, the least length and count of a word, one run of how many loses a letter, and how many
#: times as frequent a word's form must be.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, EVERY, TIMES = 7, 2, 31, 10
#: Words that one key brings together, beyond which the rest of the word is halved again.
MAX_GROUP = 64
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
MASK = (1 << 64) - 1


def noised_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, min_length: int = MIN_LENGTH) -> DataFrame:
    """word and n of partial counts: the runs of letters of all texts, A-Z lowered, some without one letter.

    Which runs lose a letter, and which one, depends on the CRC-32 of id and run (a null id counts as empty).
    """
    run_of = re.compile(f"[{LETTERS}]{{{min_length},}}")  # shorter runs only get shorter

    def run(batches):
        count: Counter[str] = Counter()

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

        for b, col in slices(batches, text_col, 4 << 20):
            ids = b.column(b.schema.get_field_index("id")).to_pylist()
            for doc, text in zip(ids, pc.ascii_lower(col).to_pylist(), strict=True):
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(run_of.findall(text)).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    count[word] += n
                if len(count) > COUNTED:
                    yield batch()
                    count.clear()
        yield batch()

    return df.select(F.col(id_col).cast("string").alias("id"), text_col).mapInArrow(tidy(run), "word string, n long")


def near(a: str, b: str) -> bool:
    """b is a with exactly one letter put in, left out or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def split(rest: str, longer: bool) -> tuple[tuple[str, str], tuple[str, str]]:
    """(half, what is left) for the first and the second half.  longer: of a word that must lose a letter to be as long as
    those that are indexed."""
    k = (len(rest) - longer) // 2
    return (rest[:k], rest[k:]), (rest[k + longer :], rest[: k + longer])


def probes(words: DataFrame) -> DataFrame:
    """The first keys of each word: size (of the words indexed), path (which halves are shared), key, longer, word, n, rest."""
    size, parts = F.char_length("word"), []
    for longer in (0, 1):
        k = F.floor((size - longer) / 2).cast("int")
        first = (F.substring("word", F.lit(1), k), F.substring("word", k + 1, size))
        second = (F.substring("word", k + longer + 1, size), F.substring("word", F.lit(1), k + longer))
        for path, (half, rest) in (("1", first), ("2", second)):
            parts.append(F.struct((size - longer).alias("size"), F.lit(path).alias("path"), F.xxhash64(half).alias("key"), F.lit(bool(longer)).alias("longer"), rest.alias("rest")))
    return words.select("word", "n", F.explode(F.array(*parts)).alias("p")).select("p.*", "word", "n")


def halved(rows: DataFrame) -> DataFrame:
    """The keys of rows (as `probes` gives them) with one more half."""

    def run(batches):
        import xxhash

        for b in batches:
            rest, longer, path, key = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("rest", "longer", "path", "key"))
            out = [(p + str(i + 1), xxhash.xxh3_64_intdigest(half.encode(), k & MASK), left) for r, x, p, k in zip(rest, longer, path, key, strict=True) for i, (half, left) in enumerate(split(r, x))]
            twice = pa.array(np.repeat(np.arange(b.num_rows), 2))
            own = {"path": pa.array([o[0] for o in out], pa.string()), "key": pa.array(np.array([o[1] for o in out], np.uint64).view(np.int64)), "rest": pa.array([o[2] for o in out], pa.string())}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else b.column(i).take(twice) for i, c in enumerate(b.schema.names)], b.schema.names)

    return rows.mapInArrow(tidy(run), rows.schema)


def met_first_here(shorter: str, other: str, path: str) -> bool:
    """Two near words may share both halves' keys; only the path that takes the first half wherever it is shared counts."""
    a, b, longer = shorter, other, len(other) > len(shorter)
    for step in path:
        (one, rest_a), (two, rest_b) = split(a, False)[0], split(b, longer)[0]
        if (step == "1") != (one == two):
            return False
        if step == "2":
            rest_a, rest_b = split(a, False)[1][1], split(b, longer)[1][1]
        a, b = rest_a, rest_b
    return True


def _met(t: pa.Table) -> pa.Table:
    """For the words of small groups: how many near words each has found, and the most frequent of them."""
    t = t.sort_by([("size", "ascending"), ("path", "ascending"), ("key", "ascending")]).combine_chunks()
    size, key = t.column("size").to_numpy(), t.column("key").to_numpy()
    path, longer, word, n = (t.column(c).to_pylist() for c in ("path", "longer", "word", "n"))
    found: dict[str, list] = {}

    def note(a: int, b: int) -> None:
        for i, j in ((a, b), (b, a)):
            have = found.setdefault(word[i], [0, 0, ""])
            have[0] += 1
            if n[j] > have[1] or (n[j] == have[1] and word[j] < have[2]):
                have[1:] = n[j], word[j]

    start = np.flatnonzero(np.append(True, (size[1:] != size[:-1]) | (key[1:] != key[:-1]) | np.array([x != y for x, y in zip(path[1:], path[:-1], strict=True)], bool)))
    for a, z in zip(start.tolist(), [*start[1:].tolist(), len(word)], strict=True):
        if z - a < 2:
            continue
        here = [i for i in range(a, z) if not longer[i]]
        for k, i in enumerate(here):
            for j in (*here[k + 1 :], *(j for j in range(a, z) if longer[j])):
                if near(word[i], word[j]) and met_first_here(word[i], word[j], path[i]):
                    note(i, j)
    words = list(found)
    return pa.table({"word": pa.array(words, pa.string()), "near": pa.array([found[w][0] for w in words], pa.int64()), "best_n": pa.array([found[w][1] for w in words], pa.int64()), "best": pa.array([found[w][2] for w in words], pa.string())})


def neighbours(words: DataFrame, max_group: int = MAX_GROUP, unit_rows: int = 50_000) -> DataFrame:
    """word, near (near words that a task found: these add up), best_n and best (the most frequent of these) of words (word, n).

    Keys with up to max_group words, or with one letter left to differ, are looked at; words of any other key get keys of half
    the rest, so each round's rests are half as long.
    """
    rows, out = cut(probes(words)), None
    by = ["size", "path", "key"]
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        counted = rows.groupBy(*by).agg(F.count("*").alias("words"), F.max(F.char_length("rest") - F.col("longer").cast("int")).alias("open"))
        large = cut(counted.filter((F.col("words") > max_group) & (F.col("open") > 1)).select(*by))
        more = not large.isEmpty()
        small = rows.join(large, by, "left_anti") if more else rows
        met = small.groupBy(F.pmod(F.xxhash64(*by), F.lit(max(parts, small.count() // unit_rows + 1))).alias("unit")).applyInArrow(tidy_table(_met), "word string, near long, best_n long, best string")
        out = met if out is None else out.union(met)
        if not more:
            return out
        rows = cut(halved(rows.join(large, by, "left_semi").select(*rows.columns)))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: where the forms (word, form) lead in the end.  A form is always more frequent, so there is no circle;
    each round doubles the steps, and a step is at least TIMES as frequent, so rounds are few."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.join(at.toDF("root", "next"), "root", "left")
        on = cut(on.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = on.select("word", "root")
        if on.filter("moved").isEmpty():
            return at


def variants(words: DataFrame, times: int = TIMES, max_group: int = MAX_GROUP) -> DataFrame:
    """form, root, n_near and form_n of each word (word, n; words occur once).

    A word's near words differ by exactly one letter put in, left out or replaced.  Its form is the most frequent of them (ties:
    the smallest by code point), if that is at least `times` as frequent as the word, else null, as is form_n.  Its root is where
    forms lead, the word itself if it has none.  n_near is 0 without near words.  An empty table gives an empty result.
    """
    words = cut(words.select("word", "n"))
    found = neighbours(words, max_group).groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best"))).alias("top"))
    known = words.join(found, "word", "left")
    takes = -F.col("top.minus") >= F.col("n") * times
    known = cut(known.select("word", F.when(takes, F.col("top.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, -F.col("top.minus")).alias("form_n")))
    last = roots(known.filter("form IS NOT NULL"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """The words of all texts (see `noised_words`) that occur min_count times or more, with their forms (see `variants`).

    Null and empty texts have no words.  Texts that repeat count each time; under one id the same runs lose the same letters.
    Other columns are ignored.  Whole texts count, of any length.
    """
    counted = noised_words(df, id_col, text_col).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    return variants(counted)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; nulls, ties and repeats as in `spelling_variants`."""
    return spelling_variants(table(spark, sf_dir, "documents"))
