from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import harmonic

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(harmonic.tokenizer_path())


def test_ids_equal_the_tokenizers_own_on_odd_white_space(tokenizer):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "\x85", "\x1c", "a", "b's", "don't", "É", "’", "12", "...", "<|endoftext|>", "日本", "​", "x", "\x0b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    ids, ends = harmonic.Encoder(harmonic.tokenizer_path())(pa.array(texts, pa.large_string()))
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("room", [2048, 37, 1])
def test_classes_hold_reciprocal_parts_and_cuts_add_up(room):
    found, bounds = harmonic.cuts(room)
    sizes = harmonic.class_sizes(room)
    assert sizes.tolist() == sorted({room // k for k in range(1, room + 1)})
    assert all(found[a:z].sum() == rest for rest, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))) and set(found.tolist()) <= set(sizes.tolist())


def rows():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Alpha", "beta,", "gamma\n\n", "É", "δ", "<|endoftext|>", "x" * 40]) for _ in range(rng.choice([0, 1, 5, 80, 400, 900]))) for _ in range(150)]
    return [(i, t) for i, t in enumerate(texts)] + [(7, "twice"), (7, "twice"), (None, "no id"), (8000, None), (8001, ""), (8002, "word " * 30_000)]


@pytest.mark.parametrize(("room", "parts"), [(2048, 3), (64, 5)])
def test_every_id_lies_in_one_piece_and_sequences_have_no_gaps(spark, tokenizer, room, parts):
    data = rows()
    df = spark.createDataFrame([(t, d, "y") for d, t in data], "text string, doc_id long, sequence_id string").repartition(parts)
    got = harmonic.pack_harmonic(df, room=room, with_ids=True).toPandas()
    assert list(got.columns) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    want = sorted(repr((d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in data)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got.itertuples())
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert (x.offset == x.length.cumsum() - x.length).all() and x.length.sum() <= room
    size = got.groupby("sequence_id").length.sum()
    padding = sum(0 if n & (n - 1) == 0 else room - n for n in size)
    assert padding <= 0.02 * got.length.sum()
    got["doc_id"] = got["doc_id"].astype("object").where(got["doc_id"].notna(), None)
    texts = []
    for (d, _), x in got[got.doc_id != 7].sort_values("start").groupby(["doc_id", "doc_tokens"], dropna=False):
        assert (x.start == x.length.cumsum() - x.length).all() and (x.doc_tokens == x.length.sum()).all()
        texts.append(repr((None if d is None or d != d else int(d), [int(i) for part in x.ids for i in part])))
    seven = [int(i) for i in got[got.doc_id == 7].length]
    assert sum(seven) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in data if d == 7)
    assert sorted(texts) == [w for w in want if not w.startswith("(7,")]


def test_repeated_runs_agree_and_empty_tables_are_empty(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    one, two = (sorted(map(repr, harmonic.pack_harmonic(df).collect())) for _ in range(2))
    assert one == two
    assert harmonic.pack_harmonic(df.limit(0)).count() == 0
