from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from factloom.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, every=31):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def distance_is_one(a, b):
    if a == b:
        return False
    one = {a[:i] + a[i + 1 :] for i in range(len(a))}
    other = {b[:i] + b[i + 1 :] for i in range(len(b))}
    return b in one or a in other or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)


def brute(n):
    out = {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) < 2 and distance_is_one(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best is not None and n[best] >= 10 * n[w] else None, len(near))
    rows = []
    for w, (form, near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n[w], near, n[form] if form else None))
    return sorted(rows, key=repr)


def some_words(seed):
    rng, n = random.Random(seed), {}
    bases = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([7, 8, 8, 9, 15]))) for _ in range(25)]
    bases += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab"]
    for base in bases:
        n[base] = rng.choice([2, 30, 400, 5000])
        for _ in range(rng.randint(0, 14)):
            w = list(base)
            for _ in range(rng.choice([1, 1, 2])):
                i = rng.randrange(len(w))
                w[i : i + rng.choice([0, 1, 1])] = rng.choice(["", "a", "b", "ÿ", "é"])
            n.setdefault("".join(w), rng.choice([2, 2, 3, 20, 50]))
    return n


@pytest.mark.parametrize(("seed", "group"), [(1, 64), (2, 2), (3, 5)])
def test_variants_equal_brute_force_however_small_groups_are(spark, seed, group):
    n = some_words(seed)
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert sorted((tuple(r) for r in spelling.variants(words, max_group=group).collect()), key=repr) == brute(n)


def test_many_words_that_share_a_half_are_told_apart_by_further_halves(spark):
    rng = random.Random(4)
    n = {"prefixes" + "".join(rng.choice("abcdefgh") for _ in range(8)): rng.choice([2, 3, 40]) for _ in range(600)}
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert sorted((tuple(r) for r in spelling.variants(words, max_group=16).collect()), key=repr) == brute(n)


def test_whole_texts_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["Separate", "seperate", "GRÜNLICH", "grünlich", "ÀÉÎõøçß", "definitely", "definately", "short", "abc×÷def", "naïveté"]
    rows = [(i // 2 if i % 9 else None, rng.choice([" ", "-", "1", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "lengthy " * 50_000), (1003, "x" * 200_000), (1004, "x" * 200_000), (1005, "x" * 199_999 + " " + "x" * 199_999)]
    df = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id long, text string, n int, word string").repartition(4)
    got = sorted((tuple(r) for r in spelling.spelling_variants(df).collect()), key=lambda r: repr((r[0][:50], len(r[0]), r[3:])))
    want = sorted(brute(brute_words(rows)), key=lambda r: repr((r[0][:50], len(r[0]), r[3:])))
    assert got == want


def test_forms_are_followed_to_the_last(spark):
    n = {"abcdefg" + "h" * k: 3 * 10**k for k in range(7)}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert {r.root for r in got} == {"abcdefg" + "h" * 6} and sum(r.form is None for r in got) == 1


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_is_one_edit():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(3, 6))) for _ in range(2))
        assert spelling.near(a, b) == distance_is_one(a, b) == spelling.near(b, a)
