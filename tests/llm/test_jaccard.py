from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import jaccard, sigtree
from factloom.llm.components import connected_components, stars

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = root(i)
            least[r] = min(least.get(r, d), d)
    return sorted((repr(d), len(sets[i]), repr(least.get(root(i)))) for i, (d, _) in enumerate(rows))


def corpus():
    rng, rows = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 150))]
        if i % 3 == 0:
            base += passage
        rows.append((i * 10, " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 4, 12])):
            other = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append((rng.randint(0, 100_000), " ".join(other)))
    chain = [f"c{i}" for i in range(120)]
    for k in range(10):  # neighbours are similar, ends are not
        rows.append((5_000_000 - k, " ".join(chain[4 * k : 4 * k + 80])))
    rows += [(None, "just one"), (1, "JUST\tone"), (2, "just one"), (3, ""), (4, None), (5, " \n "), (6, "x"), (6, "x"), (7, "É x"), (8, "é x"), (9, "a b"), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("p", [jaccard.Params(), jaccard.Params(max_group=4, max_block=3, hot=5), jaccard.Params(hot=4, max_block=5), jaccard.Params(digest_bits=6)])
def test_components_equal_brute_force(spark, p):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, component_id int").repartition(4)
    got = jaccard.jaccard_groups(df, p=p).toPandas().astype(object)
    got = got.where(got.notna(), None)
    assert sorted((repr(None if d is None else int(d)), n, repr(None if c is None else int(c))) for d, n, c in got.values.tolist()) == brute(rows)


def test_near_copies_meet_across_slices_that_a_longer_text_leads(spark):
    # each partition is a slice; in each, texts that go on after the same passage come first
    rows = []
    for part in range(6):
        rows += [(10_000 + 100 * part + k, " ".join([f"p{i}" for i in range(104)] + [f"q{i}" for i in range(34)] + [f"end{part}.{k}"])) for k in range(4)]
        rows += [(100 * part + k, " ".join(f"x{part}.{k}" if i == 50 else f"p{i}" for i in range(104))) for k in range(5)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "doc_id long, text string")
    got = jaccard.jaccard_groups(df, p=jaccard.Params(hot=10)).toPandas().values.tolist()
    assert sorted((repr(d), n, repr(c)) for d, n, c in got) == brute(rows)
    assert {c for d, _, c in got} == {0, 10_000}


def test_near_copies_meet_through_a_shingle_that_no_slice_finds_frequent(spark, monkeypatch):
    # three texts of each size in each partition: too few to be frequent there, too many in all for one task
    rows = []
    for part in range(12):
        for k in range(3):
            rows.append((100 * part + k, " ".join(f"x{part}.{k}" if i == 50 else f"p{i}" for i in range(104))))
            rows.append((10_000 + 100 * part + k, " ".join([f"p{i}" for i in range(104)] + [f"q{i}" for i in range(60)] + [f"end{part}.{k}"])))
            rows.append((20_000 + 100 * part + k, " ".join(f"y{part}.{k}.{i}" for i in range(30))))
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 12), "doc_id long, text string")
    found, real = [], jaccard.thinned
    monkeypatch.setattr(jaccard, "thinned", lambda *a: found.append(real(*a)) or found[-1])
    for hot in (4, 1000):
        got = jaccard.jaccard_groups(df, p=jaccard.Params(hot=hot, unit_bytes=600)).toPandas().values.tolist()
        assert sorted((repr(d), n, repr(c)) for d, n, c in got) == brute(rows)
    assert found[0][1].count() > 0 and found[1][1].count() == 0


@pytest.mark.parametrize("partitions", ["1", "2", "8"])
def test_leads_that_share_an_ordinary_shingle_too_still_stand_for_their_slices(spark, partitions):
    # 1,200 texts, any two of which share 8 of 10 shingles, behind a leading text in each of two slices.  The leads are unlike, but
    # share one ordinary shingle, and one frequent one with the 1,200, which all of them have first among their frequent ones.
    def texts(salt):
        c, d, e = ([f"{x}{salt}.{i}" for i in range(12)] for x in "cde")
        other = [*c[:4], *e[4:7], *c[7:]]
        return ["s", *c], ["s", *other], [*c[7:], *d[:7]], c[:11], other[:11]

    def first(words):
        return int(jaccard.shingle_sets(pa.array([" ".join(words)], pa.large_string()))[0][0])

    def unlucky(one, two, body, *_):
        frequent = first(body[:5])
        return first(one[:5]) < frequent == first(body) == first(one[1:]) == first(two[1:])

    one, two, body, *fill = next(t for t in map(texts, range(100_000)) if unlucky(*t))
    rows = []
    for part, lead in enumerate((one, two)):
        near = [(10 + 600 * part + k, " ".join([*body, f"own{part}.{k}"])) for k in range(600)]
        long = [(5000 + 2000 * part + 600 * i + k, " ".join([*f, *(f"u{part}.{i}.{k}.{j}" for j in range(20))])) for i, f in enumerate(fill) for k in range(550)]
        rows.append([(part, " ".join(lead)), *near, *long])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(spark.sparkContext.parallelize([0, 1], 2).flatMap(lambda part: rows[part]), "doc_id long, text string")
        got = jaccard.jaccard_groups(df).toPandas()
        assert set(got[(got.doc_id >= 10) & (got.doc_id < 1210)].component_id) == {10}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_equal_node_sets_are_joined_untested_if_any_of_them_stands_for_others(spark):
    # the same two nodes under two shingles of one bucket: once to be tested, once as leads, in either order
    for sure in ([0, 0, 2, 2], [2, 2, 0, 0]):
        cells = [np.array([1, 1, 2, 2], np.uint64), np.array([10, 20, 10, 20], np.int64), np.array([9, 9, 9, 9], np.int32), np.array(sure, np.uint8)]
        packed = spark.createDataFrame([(0, 0, *(bytearray(c.tobytes()) for c in cells))], jaccard.PACKED)
        got = jaccard.groups(packed, jaccard.Params()).collect()
        assert [(r.gid, r.a, r.b) for r in got] == [(None, 10, 20)]


@pytest.mark.parametrize("seed", range(3))
def test_random_slices_with_leads_that_share_ordinary_shingles(spark, seed):
    rng = random.Random(seed)
    rows, doc = [], 0
    runs = [[f"r{r}.{i}" for i in range(30)] for r in range(3)]
    bits = [[f"b{r}.{i}" for i in range(5)] for r in range(4)]
    for part in range(8):
        mine = []
        for _ in range(rng.randint(4, 9)):
            run = rng.choice(runs)
            kind = rng.random()
            if kind < 0.6:  # near copies of a run
                words = list(run)
                words[rng.randrange(30)] = f"x{doc}"
            elif kind < 0.8:  # pieces of a run and of what leads share
                words = [*rng.choice(bits), *run[:6], *rng.choice(bits), f"y{doc}"]
            else:
                words = [f"z{doc}.{i}" for i in range(rng.randint(1, 9))] + rng.choice(bits)
            mine.append((doc, " ".join(words)))
            doc += 1
        rng.shuffle(mine)
        rows += [(part, *m) for m in mine]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 64).map(lambda r: r[1:]), "doc_id long, text string").coalesce(8)
    want = brute([r[1:] for r in rows])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "3"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = jaccard.jaccard_groups(df, p=jaccard.Params(hot=4)).toPandas().values.tolist()
            assert sorted((repr(d), n, repr(c)) for d, n, c in got) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_of_each_group_stays(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in jaccard.one_of_each(df).collect()]
    groups = len({c for _, n, c in brute([r for r in rows if r[0] is not None]) if n})
    assert len([r for r in kept if shingles(r[1]) and r[0] is not None]) == groups
    assert sum(not shingles(t) for _, t in kept) == sum(not shingles(t) for _, t in rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_groups(df).count() == 0 and jaccard.one_of_each(df).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(12)] + [(100, i) for i in range(101, 120)] + [(7, 7), (200, 200)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(13)} == {0} and {got[i] for i in range(100, 120)} == {100} and got[200] == 200


def test_components_take_few_jobs(spark):
    """The driver plans each job and keeps what it needs for it, so rounds of small jobs fill its memory."""
    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(0, 400, (300, 2))]
    df = spark.createDataFrame(edges, "a long, b long").coalesce(1).checkpoint()
    sc = spark.sparkContext
    sc.setJobGroup("components", "")
    try:
        got = dict(connected_components(df).collect())
        jobs = len(sc.statusTracker().getJobIdsForGroup("components"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    assert {got[i] for i in range(301)} == {0}
    assert jobs <= 16


@pytest.mark.parametrize("chunk", [1, 3, 50, 10_000])
def test_stars_keep_components(spark, chunk):
    rng = np.random.default_rng(chunk)
    edges = [(int(a), int(b)) for a, b in rng.integers(-150, 150, (200, 2))] + [(500, 500), (3, 3), (501, 500), (502, 502)]

    def components(edges):
        up = {x: x for e in edges for x in e}
        for _ in up:
            for a, b in edges:
                up[a] = up[b] = min(up[a], up[b])
        return up

    with_batches = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = [tuple(r) for r in stars(with_batches, chunk).collect()]
    assert all(a <= b for a, b in got) and components(got) == components(edges)
    found = dict(connected_components(with_batches).collect())
    want = components(edges)
    assert set(found) == set(want) and len({(found[x], want[x]) for x in want}) == len(set(want.values())) == len(set(found.values()))


def test_tree_links_equal_brute_force():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 5000).astype(np.uint64)
    sets = []
    for _ in range(150):
        base = rng.choice(pool, rng.integers(1, 300), replace=False)
        sets += [np.unique(np.where(rng.random(len(base)) < f, rng.choice(pool, len(base)), base)) for f in (0, 0.05, 0.12)]

    def similar(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)

    sizes, n = np.array([len(s) for s in sets]), len(sets)
    forest, want = sigtree.Forest(n), sigtree.Forest(n)
    sigtree.link(forest, sizes, [sigtree.bitmap(s) for s in sets], similar)
    for i in range(n):
        for j in range(i):
            if similar(i, j):
                want.join(i, j)
    assert (forest.roots(np.arange(n)) == want.roots(np.arange(n))).all()


def test_shingles_of_very_long_text():
    text = " ".join(f"w{i % 5000}" for i in range(60_000))
    h, bounds = jaccard.shingle_sets(pa.array([text, "", "a b"], pa.large_string()))
    assert np.diff(bounds).tolist() == [len(shingles(text)), 0, 1]
