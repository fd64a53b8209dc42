"""Language identification with error-correcting output codes.

Each language gets a codeword; a binary classifier for each bit of the code is a linear function of hashed byte n-grams.
The classifiers' weights follow from n-gram counts by language, which every partition sums over all its training rows.
Loss-weighted decoding picks the codeword with the least loss; a narrow lead over the next one marks the text ambiguous.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import is_remainder, slices, table, text_bytes, tidy

UNKNOWN = "und"
#: Hash buckets of n-grams, bits of a codeword (at least; twice the languages, if those are more), and pseudo-counts.
BUCKETS, MIN_BITS, SMOOTHING = 4096, 15, 0.5
#: A lead in loss below this share of the best codeword's margin marks a text ambiguous.
NARROW = 0.02
GROUP = 256


def codewords(n: int, bits: int = MIN_BITS) -> np.ndarray:
    """n rows of +1 and -1, far apart: greedily chosen from fixed pseudo-random rows; no column is constant (n > 1)."""
    bits = max(bits, 2 * n)
    rng, best, far = np.random.default_rng(20_240_229), None, -1
    for _ in range(300):
        code = rng.choice([-1, 1], (n, bits))
        if n > 1:
            flat = np.abs(code.sum(0)) == n
            code[0, flat] *= -1
        near = min(((code[i] != code[j]).sum() for i in range(n) for j in range(i)), default=bits)
        if near > far:
            best, far = code, near
    return best


def ngram_counts(col: pa.Array) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-byte sequences (A-Z lowered, other bytes than letters as one) of each text."""
    data, ends = text_bytes(pc.ascii_lower(col))
    letter = (data >= 97) & (data <= 122) | (data >= 128)
    b = np.where(letter, data, 32).astype(np.uint32)
    n = len(ends) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    if not len(b):
        return out
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(ends))
    b1 = np.concatenate([[32], b[:-1]]).astype(np.uint32)
    b2 = np.concatenate([[32, 32], b[:-2]]).astype(np.uint32)[: len(b)]
    first = np.zeros(len(b), bool)
    first[ends[:-1][np.diff(ends) > 0]] = True
    b1[first] = 32
    b2[first] = 32
    b2[1:][first[:-1]] = 32
    keep = letter | (b1 != 32)
    with np.errstate(over="ignore"):
        two, three = b1 << np.uint32(8) | b, b2 << np.uint32(16) | b1 << np.uint32(8) | b
        for gram, seed in ((b, 0x9E3779B1), (two, 0x85EBCA6B), (three, 0xC2B2AE35)):
            h = (gram + np.uint32(1)) * np.uint32(seed)
            h = (h ^ h >> np.uint32(15)) >> np.uint32(7) & np.uint32(BUCKETS - 1)
            for at in range(0, n, GROUP):
                lo, hi = ends[at], ends[min(n, at + GROUP)]
                use = keep[lo:hi]
                m = min(GROUP, n - at)
                out[at : at + m] += np.bincount((row[lo:hi][use] - at) * BUCKETS + h[lo:hi][use], minlength=m * BUCKETS).reshape(m, BUCKETS)
    return out


class Model:
    """languages (sorted), code (languages x bits), weights (buckets x bits), trust (bits): what prediction needs."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True)  # each language counts alike
        bits = self.code.shape[1]
        self.weights, self.trust = np.zeros((BUCKETS, bits), np.float32), np.ones(bits)
        for k in range(bits):
            one, two = self.code[:, k] > 0, self.code[:, k] < 0
            if one.any() and two.any():
                self.weights[:, k] = np.log(share[one].mean(0)) - np.log(share[two].mean(0))
                margin = (share @ self.weights[:, k]) * self.code[:, k]  # of each language's mean text
                self.trust[k] = max(margin.min(), 0.0) / max(margin.mean(), 1e-9)
        if self.trust.sum() <= 0:
            self.trust[:] = 1.0
        self.trust /= self.trust.sum()
        self.scale = 1.0 / np.maximum(np.abs(share @ self.weights).mean(0), 1e-9)

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword's index, a probability-like score, and whether the next codeword is as near."""
        total = counts.sum(1, keepdims=True)
        margin = np.tanh((counts @ self.weights) / np.maximum(total, 1) * self.scale)
        loss = np.log1p(np.exp(-3 * margin[:, None, :] * self.code[None])) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        lead = loss[np.arange(len(loss)), order[:, 1]] - loss[np.arange(len(loss)), best] if loss.shape[1] > 1 else np.ones(len(loss))
        like = np.exp(-6 * (loss - loss.min(1, keepdims=True)))
        return best, 1 / like.sum(1), (lead < NARROW) | (total[:, 0] == 0)


def has_letter(text: Column) -> Column:
    return F.coalesce(F.coalesce(text, F.lit("")).rlike(r"\p{L}"), F.lit(False))


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """A model from all rows of df with a text that has a letter, and a language; None without such rows.

    Each partition sums n-gram counts by language; the languages (few by nature) and their sums reach the driver.
    """

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b, col in slices(batches, text):
            names = b.column(lang).to_numpy(zero_copy_only=False)
            grams = ngram_counts(col)
            for name in set(names):
                total[name] = total.get(name, 0.0) + grams[names == name].sum(0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "counts": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))})

    rows = df.filter(F.col(lang).isNotNull() & has_letter(F.col(text))).select(F.col(text), F.col(lang).cast("string").alias(lang))
    part = rows.mapInArrow(tidy(count), "lang string, counts array<double>")
    at = part.select("lang", F.posexplode("counts").alias("bucket", "n")).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by = at.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda x: x.n).alias("n")).orderBy("lang").collect()
    return Model([r.lang for r in by], np.array([r.n for r in by])) if by else None


def identify(df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) and lang_pred, score (0 to 1), ambiguous.

    lang_pred is `und`, with score 0, where the text is null or has no letter, or no model could be learned.  All bytes
    of a text count, however long; ties go to the first language by code point.  Columns of df with these names go.
    """
    kept = df.drop("lang_pred", "score", "ambiguous", "__letter")
    if model is None:
        return kept.select(*(keep or kept.columns)).withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "ambiguous": F.lit(True)})
    names = [c for c in kept.columns if keep is None or c in keep]

    def predict(batches):
        for b, col in slices(batches, text):
            best, score, narrow = model.decode(ngram_counts(col))
            letter = b.column("__letter").to_numpy(zero_copy_only=False)
            named = np.array(model.languages, object)[best]
            named[~letter] = UNKNOWN
            cols = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(named, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(narrow | ~letter)], [*names, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{c}` {t}" for c, t in kept.select(*names).dtypes) + ", lang_pred string, score double, ambiguous boolean"
    return kept.withColumn("__letter", has_letter(F.col(text))).mapInArrow(tidy(predict), schema)


def recognised(docs: DataFrame, learn_from: Column) -> DataFrame:
    """The rows of docs in a language that the model knows and tells apart, learned where learn_from holds.

    Null, empty and letterless texts go.  Rows are judged one by one, so equal texts stay or go together and repeats stay
    repeated.  Without anything to learn from no language is known, and no row stays.
    """
    model = train(docs.filter(learn_from))
    out = identify(docs, model)
    return out.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select(*docs.columns)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from those whose crc32 modulo 3 is not 1.  Null, empty and letterless texts are `und`; a row that
    repeats is judged each time; rows without lang teach nothing; see `identify`."""
    docs = table(spark, sf_dir, "documents")
    held = is_remainder(F.col("doc_id"), 3, 1)
    model = train(docs.filter(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model, keep=["doc_id", "held_out"])
