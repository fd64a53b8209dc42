"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of every whole text are computed once, in one pass over the bytes.  Random Fourier features approximate a
Gaussian kernel over them; each partition sums its part of the normal equations, whose size depends on the number of
features alone.  The ridge scores of rows that the regression hasn't seen are calibrated by isotonic regression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import cut, is_remainder, slices, summed, sums, table, text_bytes, tidy, words

#: Random features, kernel width (in standard deviations), ridge penalty a row.
FEATURES, WIDTH, RIDGE = 256, 4.0, 1e-3
#: Labelled rows to learn from, at most (about; chosen by hash), the share of them kept for calibration, and the
#: partitions that sum the normal equations.
MAX_LABELLED, CALIBRATION, PARTS = 200_000, 0.25, 16
#: A text is rejected if its score is below this.
KEEP_FROM = 0.5

CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\r\v\f",
    "line": b"\n",
    "stop": b".?",
    "comma": b",;:'\"-()",
    "bang": b"!",
    "bar": b"|",
    "mark": b"#$%&*+/<=>@[\\]^_`{}~",
    "other": bytes(range(128, 256)),
}
NAMES = [*CLASSES, "log_bytes", "log_lines", "word_bytes", "long_words", "short_words", "distinct_words", "caps_words", "line_words", "top_word", "repeated_lines"]


def statistics(col: pa.Array) -> np.ndarray:
    """One row of numbers for each text: shares of byte classes, and shape of words and lines."""
    data, ends = text_bytes(col)
    n = len(ends) - 1
    size = np.diff(ends)
    some = np.maximum(size, 1)
    out = np.zeros((n, len(NAMES)))
    for k, members in enumerate(CLASSES.values()):
        lut = np.zeros(256, np.int8)
        lut[list(members)] = 1
        out[:, k] = sums(lut[data], ends) / some
    lines = sums(data == 10, ends) + 1
    flat, bounds = words(col, lower=False)
    count = np.diff(bounds)
    has = np.maximum(count, 1)
    k = len(CLASSES)
    out[:, k] = np.log1p(size)
    out[:, k + 1] = np.log(lines)
    if len(flat):
        at, length = text_bytes(flat)[1], np.diff(text_bytes(flat)[1])
        raw = text_bytes(flat)[0]
        upper = sums((raw >= 65) & (raw <= 90), at)
        lower = sums((raw >= 97) & (raw <= 122), at)
        out[:, k + 2] = sums(length, bounds) / has
        out[:, k + 3] = sums(length > 12, bounds) / has
        out[:, k + 4] = sums(length <= 2, bounds) / has
        out[:, k + 6] = sums((upper > 1) & (lower == 0), bounds) / has
        code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = np.sort(np.repeat(np.arange(n), count) * (int(code.max()) + 1) + code)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        doc, times = key[new] // (int(code.max()) + 1), np.diff(np.append(np.flatnonzero(new), len(key)))
        out[:, k + 5] = np.bincount(doc, minlength=n) / has
        most = np.zeros(n)
        np.maximum.at(most, doc, times)
        out[:, k + 8] = most / has
    out[:, k + 7] = np.log1p(count / lines)
    out[:, k + 9] = _repeated_lines(data, ends)
    return out


def _repeated_lines(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The share of each text's lines that an earlier line equals (by a 64-bit polynomial hash and the length)."""
    n = len(ends) - 1
    if not len(data):
        return np.zeros(n)
    stop = np.union1d(np.flatnonzero(data == 10) + 1, ends[1:])
    stop = stop[stop > 0]
    start = np.concatenate([[0], stop[:-1]])
    with np.errstate(over="ignore"):
        place = np.arange(len(data)) - np.repeat(start, stop - start)
        h = (data.astype(np.uint64) + np.uint64(1)) * np.power(np.uint64(0x9E3779B97F4A7C15), (place % 61).astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) + np.uint64(7))
        own = np.add.reduceat(h, start)
    doc = np.searchsorted(ends, start, side="right") - 1
    order = np.lexsort((own, doc))
    same = (own[order][1:] == own[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & ((stop - start)[order][1:] > 1)
    return np.bincount(doc[order][1:][same], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1)


def with_statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep and `stats`, an array of NAMES' numbers (a null text counts as empty)."""

    def run(batches):
        for b, col in slices(batches, text):
            s = statistics(col).astype(np.float32)
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * s.shape[1], pa.int32()), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), stats], [*keep, "stats"])

    rows = df.select(*keep, *([] if text in keep else [text]))
    return rows.mapInArrow(tidy(run), ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes) + ", stats array<float>")


def _rows(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(np.float64)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y (pool adjacent violators); equal x count as one point."""
    points, at = np.unique(x, return_inverse=True)
    n = np.bincount(at).astype(float)
    blocks: list[list[float]] = []
    for p, mean, weight in zip(points, np.bincount(at, y) / n, n, strict=True):
        blocks.append([p, p, mean, weight])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            _, high, m2, w2 = blocks.pop()
            low, _, m1, w1 = blocks.pop()
            blocks.append([low, high, (m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2])
    return np.array([v for b in blocks for v in b[:2]]), np.array([b[2] for b in blocks for _ in range(2)])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        """The calibrated score; a hundredth of it follows the ridge score, so that order survives within a step."""
        raw = self.raw(stats)
        return np.clip(0.99 * np.interp(raw, self.knots, self.levels) + 0.01 * np.clip(raw, 0, 1), 0, 1)


def train(rows: DataFrame, id_col: str = "doc_id", label: str = "quality") -> Model | None:
    """A model from rows with `stats` and a label of 0 or 1; None if there are no such rows.

    About MAX_LABELLED rows, chosen by a hash of their id, are used if there are more; rows with another label or null
    are not.  With one label only, every score is that label.
    """
    spark = rows.sparkSession
    labelled = rows.filter(F.col(label).isin(0, 1)).select(F.xxhash64(F.col(id_col)).alias("h"), "stats", F.col(label).cast("double").alias("y"))
    labelled = cut(labelled)
    n = labelled.count()
    if not n:
        return None
    if n > MAX_LABELLED:
        labelled = labelled.filter(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * MAX_LABELLED / n))
    parts = cut(labelled.repartition(PARTS, "h"))
    calibrating = F.pmod(F.shiftright("h", 20), F.lit(1 << 20)) < int((1 << 20) * CALIBRATION)
    d, rng = len(NAMES), np.random.default_rng(7)

    def moments(batches):
        s = np.zeros((3, d))
        for b in batches:
            x = _rows(b.column("stats"))
            s += [np.full(d, len(x)), x.sum(0), (x**2).sum(0)]
        return s.ravel()

    s = summed(parts, moments).reshape(3, d)
    mean = s[1] / s[0]
    scale = np.sqrt(np.maximum(s[2] / s[0] - mean**2, 0))
    scale[scale < 1e-6] = 1.0
    model = Model(mean, scale, rng.normal(0, 1 / WIDTH, (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(0), np.zeros(0), np.zeros(0))
    m = FEATURES + d + 1

    def normal(batches):
        a = np.zeros((m, m + 1))
        for b in batches:
            z, y = model.features(_rows(b.column("stats"))), b.column("y").to_numpy()
            w = np.where(y > 0.5, weight[1], weight[0])
            a += (z * w[:, None]).T @ np.hstack([z, y[:, None]])
        return a.ravel()

    by = {r.y: r["count"] for r in parts.filter(~calibrating).groupBy("y").count().collect()}
    weight = [0.5 * sum(by.values()) / max(by.get(y, 1), 1) for y in (0.0, 1.0)]
    a = summed(parts.filter(~calibrating), normal).reshape(m, m + 1)
    penalty = RIDGE * max(sum(by.values()), 1) * np.eye(m)
    penalty[-1, -1] = 1e-9
    model.beta = np.linalg.solve(a[:, :m] + penalty, a[:, m])

    def judged(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array(model.raw(_rows(b.column("stats")))), "y": b.column("y")})

    held = parts.filter(calibrating).mapInArrow(tidy(judged), "x double, y double").toPandas()  # bounded by MAX_LABELLED
    if not len(held):
        held = parts.mapInArrow(tidy(judged), "x double, y double").toPandas()
    model.knots, model.levels = isotonic(held.x.to_numpy(), held.y.to_numpy())
    return model


def score(rows: DataFrame, model: Model | None, score_col: str = "score") -> DataFrame:
    """rows, with the score in place of `stats`; 0.5 if no model could be learned."""
    kept = [c for c in rows.columns if c != "stats"]
    if model is None:
        return rows.select(*kept, F.lit(0.5).alias(score_col))

    def run(batches):
        for b in batches:
            got = model.score(_rows(b.column("stats"))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(got)], [*kept, score_col])

    return rows.mapInArrow(tidy(run), ", ".join(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes) + f", `{score_col}` double")


def judge(docs: DataFrame, labels: DataFrame, learn_from, keep: tuple[str, ...] = ()) -> DataFrame:
    """Quality of every row of docs (doc_id, text), learned from labels (doc_id, quality) where learn_from holds.

    Returns doc_id, the columns in keep and score.  A null text counts as empty.  Ids with labels that differ count
    with each of them; rows that share an id and a label count as often as they occur.
    """
    rows = cut(with_statistics(docs, ["doc_id", *keep]))
    model = train(rows.filter(learn_from).join(labels.select("doc_id", "quality").distinct(), "doc_id"))
    return score(rows, model)


def good(docs: DataFrame, labels: DataFrame, learn_from) -> DataFrame:
    """The rows of docs (doc_id, text and others) with a score of KEEP_FROM or more.

    A null text counts as empty.  Rows are judged one by one, so equal texts stay or go together and repeats stay repeated.
    Without labels to learn from all rows stay.
    """
    model = train(with_statistics(docs.filter(learn_from), ["doc_id"]).join(labels.select("doc_id", "quality").distinct(), "doc_id"))
    if model is None:
        return docs

    def run(batches):  # texts go through one worker, once
        for b, col in slices(batches, "text"):
            yield b.filter(pa.array(model.score(statistics(col).astype(np.float32).astype(np.float64)) >= KEEP_FROM))

    return docs.mapInArrow(tidy(run), docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null and empty texts get a score as others do, equal texts equal ones, repeats a row each; see `judge`."""
    held = is_remainder(F.col("doc_id"), 3, 1)
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
