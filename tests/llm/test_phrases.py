from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, enough, most, first):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {x: c for x, c in f.items() if c >= enough}
    out = []
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        held = any(g == lang and len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), c in often.items())
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        if not held:
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked, seen = [], Counter()
    for lang, p, a, l, r, total, score in sorted(out, key=lambda x: (-x[6], -x[2], x[1].encode())):  # noqa: E741
        seen[lang] += 1
        if seen[lang] <= first:
            ranked.append((lang, seen[lang], p, a, l, r, total, score))
    return sorted(ranked)


def corpus(seed=1):
    rng, rows = random.Random(seed), []
    words = ["a", "b", "É", "x-y", "The", "the", "日本", "c'd", "Z\x1f", "na ive"]
    fixed = ["new york city", "a a a a a a", "of The the", "x-y \t x-y b", "É É; b a"]
    for i in range(300):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(rng.choice(fixed) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 7))))
        rows.append((rng.choice([". ", "\n", ",", " ", "  ", "\x0b", "?!"]).join(parts), rng.choice(["en", "en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", None), (" .\t", "fr"), *[("new york city of the", "en")] * 40, ("long tail " * 20_000, "en")]


@pytest.mark.parametrize(("enough", "most", "first"), [(25, 5, 2000), (4, 4, 7), (300, 5, 3)])
def test_collocations_equal_brute_force(spark, enough, most, first):
    rows = corpus()
    df = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n int, phrase string").repartition(5)
    got = phrases.collocations(df, first, min_count=enough, max_words=most)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, enough, most, first)


def test_small_bitmaps_only_let_more_pass(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", 8)
    monkeypatch.setattr(phrases, "MOST_BITS", 8)
    rows = corpus(2)
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(3), min_count=30)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 30, 5, 2000)


def test_phrases_that_the_bitmaps_rule_out_are_not_counted(spark):
    rows = [(f"u{i} v{i} w{i} good morning all", "en") for i in range(500)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    first = phrases.counted(df, 1, 100, 16)
    often = first.filter("lang IS NOT NULL").groupBy("lang", "phrase").sum("n").filter("`sum(n)` >= 100")
    kept = phrases.phrase_bitmap(often, 16), phrases.bitmap(first.filter("chunk IS NOT NULL"), 16, 100)
    second = phrases.counted(df, 2, 100, None, *kept).groupBy("phrase").sum("n").collect()
    assert {r[0]: r[1] for r in second if r[1] >= 100} == {"good morning": 500, "morning all": 500}
    assert len(second) < 20  # of 1,502 different pairs


def test_empty_tables_and_texts(spark):
    for rows in ([], [(None, None), ("", "en"), (" ,\t", "en")]):
        assert phrases.collocations(spark.createDataFrame(rows, "text string, lang string")).count() == 0


def test_bucket_counts_stay_within_their_type_and_reach_the_bound():
    have = phrases._Buckets(10, 100)
    h = np.repeat(np.arange(4, dtype=np.uint64) << np.uint64(60), [1, 99, 100, 70_000])
    for part in np.array_split(h, 9):
        have.add(part)
    have._merge()
    assert have.at.tolist() == [0, 64, 128, 192] and have.times.tolist() == [1, 99, 100, 100]


def test_scores_beyond_64_bits_are_exact(spark):
    big = 3_037_000_499 * 1_000_003
    rows = [("en", 1, "p", big), ("en", 1, "q", big - 7), ("en", 2, "p q", big - 11)]
    frequent = spark.createDataFrame(rows, "lang string, words int, phrase string, n long")
    totals = spark.createDataFrame([("en", 9_000_000_000_000_000_000)], "lang string, total long")
    got = phrases.ranked(frequent, totals, 10).collect()
    assert [r.score for r in got] == [1000 * (big - 11) * 9_000_000_000_000_000_000 // (big * (big - 7))]


def test_words_lie_where_brute_force_finds_them():
    texts = ["A b,c", "", "\n\n", "é x  y\tz.", "last"]
    w = phrases.Words(pa.array(texts, pa.large_string()), pa.array(["x", None, "y", "x", None]))
    names = [w.names[int(c)].as_py() for c in w.code]
    assert names == ["a", "b", "c", "é x", "y", "z", "last"]
    assert [int(x) for x in np.diff(w.piece) == 0] == [1, 0, 0, 1, 1, 0] and [w.langs[int(x)].as_py() for x in w.lang] == ["x"] * 6 + ["und"]
