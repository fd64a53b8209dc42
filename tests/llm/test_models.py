from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import langid, maxent, quality
from factloom.llm.common import is_remainder, mix64, summed

STEMS = {"aa": ["kel", "mor", "tis"], "bb": ["zou", "vieu", "queé"], "cc": ["schö", "üng", "dern"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(600):
        lang, good = rng.choice(list(STEMS)), rng.random() < 0.7
        text = sentence(rng, lang, rng.randint(5, 60))
        out.append((i, text if good else " | ".join(text.upper().split()) + " %%%", lang, "s", len(text), int(good)))
    return out


def frame(spark, rows):
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "12 34!", "bb"), (None, "kelmor tis", "aa"), (5, "kelmor tis", "aa"), (5, "kelmor tis", "aa"), (1003, "mortis " * 30_000, "aa")]
    data = [(i, t, lang, 1.5, "clash") for i, t, lang, *_ in rows] + [(i, t, lang, 1.5, "clash") for i, t, lang in odd]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, score double, stats string")


def test_languages_of_held_out_texts(spark, rows):
    df = frame(spark, rows)
    held = is_remainder(F.col("doc_id"), 3, 1)
    got = langid.identify(df.withColumn("held_out", held), langid.train(df.filter(~held))).toPandas()
    assert len(got) == df.count() and got.score.between(0, 1).all()
    part = got[got.held_out & (got.doc_id < 1000)]
    assert (part.lang == part.lang_pred).mean() > 0.97
    none = got[got.text.isna() | ~got.text.fillna("").str.contains("[a-zäöüé]", regex=True, case=False)]
    assert len(none) == 3 and set(none.lang_pred) == {"und"}
    assert langid.recognised(df, ~held).columns == df.columns


def test_codewords_are_far_apart_and_columns_split_the_languages():
    for n in (1, 2, 4, 30):
        code = langid.codewords(n)
        assert code.shape[0] == n and (n == 1 or min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= code.shape[1] // 4)


def plain_grams(text):
    """Bucket counts of a text's 1-, 2- and 3-byte sequences, a byte at a time."""
    out, back = np.zeros(langid.BUCKETS), [32, 32]
    for c in "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text).encode():
        b = c if 97 <= c <= 122 or c >= 128 else 32
        if b != 32 or back[1] != 32:
            for gram, seed in ((b, 0x9E3779B1), (back[1] << 8 | b, 0x85EBCA6B), (back[0] << 16 | back[1] << 8 | b, 0xC2B2AE35)):
                h = (gram + 1) * seed % 2**32
                out[(h ^ h >> 15) >> 7 & langid.BUCKETS - 1] += 1
        back = [back[1], b]
    return out


def plain_decoding(by_language, texts):
    """(language, score, ambiguous) of each text: bit classifiers, loss of each codeword, the least one."""
    names = sorted(by_language)
    code = langid.codewords(len(names))
    share = []
    for name in names:
        counts = sum(plain_grams(t) for t in by_language[name]) + langid.SMOOTHING
        share.append(counts / counts.sum())
    weights, trust, scale = [], [], []
    for k in range(code.shape[1]):
        one, two = ([share[i] for i in range(len(names)) if code[i, k] == bit] for bit in (1, -1))
        w = np.log(sum(one) / len(one)) - np.log(sum(two) / len(two))
        margins = [float(share[i] @ w) * code[i, k] for i in range(len(names))]
        weights.append(w)
        trust.append(max(min(margins), 0) / max(sum(margins) / len(margins), 1e-9))
        scale.append(sum(abs(m) for m in margins) / len(margins))
    out = []
    for t in texts:
        grams = plain_grams(t)
        f = [math.tanh(float(grams @ w) / max(grams.sum(), 1) / max(c, 1e-9)) for w, c in zip(weights, scale, strict=True)]
        loss = [sum(q * math.log1p(math.exp(-3 * x * bit)) for q, x, bit in zip(trust, f, row, strict=True)) / sum(trust) for row in code]
        best = min(range(len(names)), key=lambda i: (round(loss[i], 9), i))
        rest = sorted(loss[:best] + loss[best + 1 :])
        out.append((names[best], 1 / sum(math.exp(6 * (loss[best] - x)) for x in loss), rest[0] - loss[best] < langid.NARROW))
    return out


def test_languages_equal_brute_force(spark, rows):
    learn = [(i, t, lang) for i, t, lang, *_ in rows[:90]]
    ask = [t for _, t, *_ in rows[90:130]] + ["kelmor zouvieu", "É", "a", "xyz " * 400, "Kel\nMOR-tis 7"]
    df = spark.createDataFrame(learn + [(-1, "123 !", "aa"), (-2, "kel", None), (-3, None, "bb")], "doc_id long, text string, lang string")
    model = langid.train(df.repartition(5))
    got = langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(ask)], "i long, text string"), model).orderBy("i").collect()
    by = {lang: [t for _, t, x in learn if x == lang] for lang in STEMS}
    want = plain_decoding(by, ask)
    assert [(r.lang_pred, r.ambiguous) for r in got] == [(name, narrow) for name, _, narrow in want]
    assert np.allclose([r.score for r in got], [x for _, x, _ in want], atol=1e-4)


def test_languages_that_tie_go_to_the_first_and_are_ambiguous(spark):
    same = "kel mor tis kelmor"
    df = spark.createDataFrame([(1, same, "bb"), (2, same, "aa"), (3, "zou vieu queé", "cc")], "doc_id long, text string, lang string")
    got = langid.identify(df, langid.train(df)).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.ambiguous) for r in got] == [("aa", True), ("aa", True), ("cc", False)]
    assert [r.doc_id for r in langid.recognised(df, F.lit(True)).collect()] == [3]


def test_language_without_training_rows_or_with_one_language(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert langid.train(df) is None
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}
    one = spark.createDataFrame([(1, "abc", "aa")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(one, langid.train(one)).collect()] == ["aa"]
    assert langid.identify(df.limit(0), None).count() == 0


def test_quality_of_held_out_texts(spark, rows):
    labels = spark.createDataFrame([(i, q) for i, *_, q in rows] + [(1000, None), (1001, 7)], "doc_id long, quality int")
    df = frame(spark, rows)
    held = is_remainder(F.col("doc_id"), 3, 1)
    got = quality.judge(df, labels, ~held).toPandas()
    assert len(got) == df.count() and got.score.between(0, 1).all()
    truth = {i: q for i, *_, q in rows}
    part = [(s >= 0.5) == bool(truth[int(i)]) for i, s in got[["doc_id", "score"]].values.tolist() if i == i and i in truth and zlib.crc32(str(int(i)).encode()) % 3 == 1]
    assert len(part) > 100 and np.mean(part) > 0.97
    kept = quality.good(df, labels, ~held)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()


def test_quality_without_labels_and_without_rows(spark, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judge(frame(spark, rows[:3]), labels, F.lit(True)).toPandas()
    assert set(got.score) == {0.5}
    assert quality.judge(frame(spark, []).limit(0), labels, F.lit(True)).count() == 0
    one = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    assert (quality.judge(frame(spark, rows[:3]), one, F.lit(True)).toPandas().score > 0.9).all()


def test_quality_equals_brute_force(spark, rows):
    labels = spark.createDataFrame([(i, q) for i, *_, q in rows], "doc_id long, quality int")
    df = spark.createDataFrame([r[:2] for r in rows[:300]], "doc_id long, text string")
    joined = quality.with_statistics(df.repartition(7), ["doc_id"]).join(labels, "doc_id")
    model = quality.train(joined)
    got = joined.select("stats", "quality", F.xxhash64("doc_id").alias("h")).collect()
    x, y = np.array([r.stats for r in got], float), np.array([r.quality for r in got], float)
    kept = np.array([(r.h >> 20) % (1 << 20) >= int((1 << 20) * quality.CALIBRATION) for r in got])
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-6] = 1
    rng, d, m = np.random.default_rng(7), x.shape[1], quality.FEATURES
    w, b = rng.normal(0, 1 / quality.WIDTH, (d, m)), rng.uniform(0, 2 * np.pi, m)
    design = []
    for row in x:
        z = np.clip((row - mean) / spread, -8, 8)
        design.append([*(math.sqrt(2 / m) * math.cos(float(z @ w[:, k]) + b[k]) for k in range(m)), *z, 1.0])
    design = np.array(design)
    # weighted ridge as least squares over added rows, which never forms the normal equations
    share = {q: 0.5 * kept.sum() / (y[kept] == q).sum() for q in (0.0, 1.0)}
    root = np.sqrt([share[q] for q in y[kept]])
    penalty = np.sqrt([*[quality.RIDGE * kept.sum()] * (m + d), 1e-9])
    beta = np.linalg.lstsq(np.vstack([design[kept] * root[:, None], np.diag(penalty)]), np.concatenate([y[kept] * root, np.zeros(m + d + 1)]), rcond=None)[0]
    raw = design @ beta
    assert np.allclose(model.raw(x), raw, atol=1e-6)
    # the isotonic value at a point: the largest, over beginnings, of the least mean over ends
    order = np.argsort(raw[~kept])
    points, truth = raw[~kept][order], y[~kept][order]
    level = [max(min(truth[i : j + 1].mean() for j in range(k, len(truth))) for i in range(k + 1)) for k in range(len(truth))]
    want = np.clip(0.99 * np.interp(raw, points, level) + 0.01 * np.clip(raw, 0, 1), 0, 1)
    assert np.allclose(model.score(x), want, atol=1e-3)


def test_statistics_do_not_depend_on_neighbours():
    texts = ["Abc def.\nAbc def.\n", "", "ÜBER!! ALLES", "x" * 10_000]
    together = quality.statistics(pa.array(texts, pa.large_string()))
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(quality.statistics(pa.array([t], pa.large_string()))[0], row)
    assert together[0][quality.NAMES.index("repeated_lines")] > 0


def test_isotonic_is_the_nearest_rising_step_function():
    x, y = np.array([0.0, 1, 1, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1, 1])
    knots, levels = quality.isotonic(x, y)
    assert (np.diff(levels) >= 0).all()
    assert np.allclose(np.interp(x, knots, levels), [0, 1 / 3, 1 / 3, 1 / 3, 1, 1])


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_language_model_counts_are_exact_and_it_beats_unigrams(spark, rows):
    data = [(i, t) for i, t, *_ in rows] + [(1000, None), (1001, ""), (None, "kelmor"), (5, "kelmor tis"), (1003, "MORTIS tis " * 20_000), (1004, "never seen é")]
    df = spark.createDataFrame([(i, t, 3) for i, t in data], "doc_id long, text string, score int").repartition(4)
    held = is_remainder(F.col("doc_id"), 7, 2)
    got = maxent.score(df, ~held).toPandas()
    assert len(got) == len(data)
    tokens = [[*WORD.findall((t or "").translate(LOW)), None] for _, t in data]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in data]
    c = collections.Counter(w for x, h in zip(tokens, out, strict=True) if not h for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted((h, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 4)) for x, h in zip(tokens, out, strict=True))
    cols = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    assert sorted(tuple(r[:4]) + (round(r[4], 4),) for r in got[cols].values.tolist()) == want
    part = got[got.held_out]
    assert part.score.sum() > part.base_score.sum()


def test_language_model_is_a_distribution(spark, rows):
    model, symbols = maxent.train(spark.createDataFrame([(t,) for _, t, *_ in rows[:100]], "text string"), steps=2)
    v = model.vocabulary
    s = v.symbols + 1
    for two, one in ((v.start, v.start), (3, 5), (v.frequent, 0)):
        key = np.arange(v.symbols)
        t = maxent.Tokens(key, np.full(len(key), one), np.full(len(key), two), np.array([0, len(key)]))
        assert (10 ** model.logs(t)).sum() == pytest.approx(1, abs=1e-3)
    assert symbols.sum() == sum(len(t.split()) + 1 for _, t, *_ in rows[:100]) and s > 0


def test_language_model_tells_frequent_words_beyond_511_apart(spark):
    texts = [" ".join(f"word{i:04d}" for i in range(k, k + 30)) for k in range(0, 900, 30)] * 3
    model, _ = maxent.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    v = model.vocabulary
    assert len(v.words) == 900
    assert len(set(maxent.shapes(pa.array([chr(97 + i) for i in range(26)])).tolist())) == 5
    logs = model.logs(v.encode(pa.array(["word0701 word0702 word0703", "word0703 word0702 word0701"], pa.large_string())))
    assert logs[1:3].sum() > logs[5:7].sum() + 1


def brute_score(model, symbols, tokens, count, n_of, kinds_of):
    """log10 of a text's probability, a token at a time from the weights."""
    v = model.vocabulary
    n, two, one, total = v.symbols + 1, v.start, v.start, 0.0

    def hashed(x):
        return int(mix64(np.array([x], np.uint64))[0])

    def share(row, k):
        e = np.exp(row.astype(np.float64) - row.max())
        return e[k] / e.sum()

    for w in tokens:
        shape = None if w is None or w in v.index else int(maxent.shapes(pa.array([w]))[0])
        s = 0 if w is None else v.index[w] if shape is None else v.frequent + shape
        c, m = int(model.cls[s]), int(model.member[s])
        outer = model.first[0] + model.first[1 + one] + model.first[1 + n + two] + model.first[1 + 2 * n + hashed(two * n + one) % maxent.TRIGRAMS]
        inner = model.bias[c] + model.within[hashed((c * n + one) * 2) % maxent.WITHIN] + model.within[hashed((c * n + two) * 2 + 1) % maxent.WITHIN]
        total += math.log10(share(outer, c) * share(inner, m))
        if shape is not None:
            total += math.log10((count[w] + 1) / (n_of[shape] + kinds_of[shape] + 1))
        two, one = one, s
    return total


@pytest.mark.parametrize("known", [1 << 18, 40, 0])
def test_language_model_scores_equal_brute_force_however_rows_lie(spark, rows, known, monkeypatch):
    monkeypatch.setattr(maxent, "FREQUENT", 60)
    monkeypatch.setattr(maxent.frequent_words, "__defaults__", (59,))
    monkeypatch.setattr(maxent, "SHARD_BYTES", 20_000)
    data = [(i, t) for i, t, *_ in rows[:150]] + [(900, None), (901, "seen once"), (902, "Kelmor " + "w" * 5000), (902, "never é")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    learn = ~is_remainder(F.col("doc_id"), 7, 2)
    got = maxent.score(df.repartition(3), learn, known=known).toPandas()
    model, symbols = maxent.train(df.repartition(3).filter(learn))
    text = {0: [WORD.findall((t or "").translate(LOW)) for _, t in data]}[0]
    count = collections.Counter(w for x, (i, _) in zip(text, data, strict=True) if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    other = [w for w in count if w not in model.vocabulary.index]
    shape = maxent.shapes(pa.array(other))
    n_of, kinds_of = np.bincount(shape, [count[w] for w in other], maxent.SHAPES), np.bincount(shape, minlength=maxent.SHAPES)
    want = sorted((i, len(x) + 1, brute_score(model, symbols, [*x, None], count, n_of, kinds_of)) for x, (i, _) in zip(text, data, strict=True))
    have = sorted(got[["doc_id", "n_tokens", "score"]].values.tolist())
    assert [r[:2] for r in have] == [list(r[:2]) for r in want]
    assert np.allclose([r[2] for r in have], [r[2] for r in want], atol=2e-3)
    again = maxent.score(df.repartition(11, "text"), learn, known=known).toPandas()
    assert np.allclose(sorted(again.score), sorted(got.score), atol=2e-3) and np.allclose(sorted(again.base_score), sorted(got.base_score))


def test_keys_that_share_64_bits_are_told_apart():
    keys = np.array([[5, 1], [5, 2], [6, 1], [5, 3]], np.uint64)
    table = maxent.Table(keys[:3], np.array([10, 20, 30]))
    assert table(keys).tolist() == [10, 20, 30, -1] and maxent.Table(keys[:0], np.zeros(0, np.int64))(keys).tolist() == [-1] * 4


def test_sums_of_many_partitions(spark):
    def f(batches):
        out = np.zeros(20_000)
        for b in batches:
            np.add.at(out, b.column("id").to_numpy() * 37 % 20_000, 1.0)
        return out

    want = np.zeros(20_000)
    np.add.at(want, np.arange(500) * 37 % 20_000, 1.0)
    assert (summed(spark.range(500, numPartitions=23), f, fan=4) == want).all()
    assert (summed(spark.range(0), f) == 0).all()


def test_language_model_without_training_texts(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    got = maxent.score(df, F.lit(False)).collect()[0]
    assert (got.n_known, got.train_tokens, got.base_score) == (0, 0, 0.0) and math.isfinite(got.score)
    assert maxent.score(df.limit(0), F.lit(True)).count() == 0
