from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import chat, packing

NASTY = st.lists(st.sampled_from([*"ab \n\\<|>/[]INSTsé", "</s>", "<|end|>", "<|turn|>", "[/INST]"]), max_size=20).map("".join)


@given(NASTY)
def test_escape_is_reversible_and_hides_control_strings(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", ""]), NASTY), min_size=1, max_size=12), st.integers(1, 5))
def test_spans_of_prefixes_make_up_the_whole(turns, window):
    inc, out = chat.Incremental(window=window), ""
    for role, text in turns:
        span, at, low, high = inc.add(role, text)
        assert at == len(out) and chat.unescape(span[low:high]) == text and chat.read_turn(span) == (role, text)
        out += span
    assert out == chat.marked_turns(turns) and not inc.rewrites


def test_templates_that_rewrite_history_are_found():
    def last_only(turns):
        return "".join(f"[{r}] " + (t if i == len(turns) - 1 else "...") for i, (r, t) in enumerate(turns))

    inc = chat.Incremental(last_only)
    inc.add("user", "one")
    inc.add("user", "two")
    assert inc.rewrites


def test_templates_that_look_far_back_are_rendered_whole():
    def numbered(turns):
        return "".join(f"{i} {r}: {t}\n" for i, (r, t) in enumerate(turns))

    def first_changes_late(turns):
        return numbered(turns if len(turns) < 50 else [("user", "cut"), *turns[1:]])

    inc, late, out = chat.Incremental(numbered), chat.Incremental(first_changes_late), ""
    turns = [("user", f"text {i}") for i in range(60)]
    for i, (role, text) in enumerate(turns):
        span, at, low, high = inc.add(role, text)
        assert at == len(out) and span == f"{i} user: {text}\n" and span[low:high] == text
        out += span
        late.add(role, text)
        assert late.rewrites == (i >= 49)
    assert out == numbered(turns) and not inc.rewrites


CONV = "conv_id long, turn long, role string, text string, n_turns int"


def test_digests_and_spans(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", None, "", "</s> é"]), 1) for c in [*range(30), None] for t in range(rng.randint(1, 9))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"text {t} <|end|>", 1) for t in range(500)] + [(3, None, "user", "no turn", 1), (3, 0, "user", "twice", 1), (3, 0, "user", "twice", 1)]
    df = spark.createDataFrame(rows, CONV).repartition(3)
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert len(got) == len({r[0] for r in rows})
    for conv, r in got.items():
        turns = sorted(((t is not None, t or 0), (role is not None, role or ""), (x is not None, x or "")) for c, t, role, x, _ in rows if c == conv)
        turns = [(role[1], x[1]) for _, role, x in turns]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss) and not r.rewrites
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == len(chat.marked_turns(turns))
    spans = chat.format_turns(df).toPandas().sort_values("position")
    for _, part in spans.groupby("conv_id"):
        assert (part.start.to_numpy()[1:] == (part.start + part.span.str.len()).to_numpy()[:-1]).all()
    assert chat.digests(df.limit(0)).count() == 0 and chat.format_turns(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(0, 40)))
def test_plan_gives_each_piece_a_place_of_its_own(counts):
    p = packing.plan(counts, 16)
    used = defaultdict(list)
    for n, count in counts.items():
        at = np.flatnonzero(p["length"] == n)
        for rank in range(count):
            k = at[np.searchsorted(p["rank"][at], rank, side="right") - 1]
            past = rank - p["rank"][k]
            used[p["seq"][k] + past // p["each"][k]].append((p["offset"][k] + past % p["each"][k] * n, n))
    for slots in used.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 16
    bins: list[int] = []  # best fit, a piece at a time
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fits = [i for i, left in enumerate(bins) if left >= n]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= n
            else:
                bins.append(16 - n)
    assert len(used) == len(bins)
    assert sum(len(s) for s in used.values()) == sum(counts.values())


TEXTS = ["", "Hello, World's BEST 123!!", "don't I'LL we've\x0bx\x0cy\x1cz é É É ﬀ ΑΣ İ", "<|endoftext|> a<|EndOfText|>b<|startoftext|>", "a" * 3000, "naïve café thin", "x.y,z;;; --- (q)", "中文 字 ١٢٣ ½ Ⅷ", "áb ç"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.sampled_from(TEXTS)), min_size=1, max_size=5))
def test_ids_equal_the_tokenizers_own(texts):
    encoder = _encoder()
    ids, ends = encoder(pa.array(texts, pa.large_string()))
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, packing.END]


def _encoder(kept=[]):  # noqa: B006
    if not kept:
        kept.append(packing.Encoder(packing.tokenizer_path()))
    return kept[0]


def test_packing_covers_every_token_once(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["alpha", "beta.", "x", "Ünder"], k=rng.randint(0, 120)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (5, "alpha"), (None, "beta"), (1002, "word " * 9000)] + [(2000 + i, "the same text") for i in range(200)]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, offset int").repartition(5)
    got = packing.pack(df, room=256, with_ids=True).collect()
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length and r.start == 256 * r.piece
    for slots in fill.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 256
    tokens = Counter(i for r in got for i in r.ids)
    encoder = _encoder()
    ids, ends = encoder(pa.array([t or "" for _, t in rows], pa.large_string()))
    assert tokens == Counter(ids.tolist())
    assert len(got) == int((-(-np.diff(ends) // 256)).sum())
    assert len(fill) <= -(-len(ids) // 256) * 1.1 + 1
    assert packing.pack(df.limit(0)).count() == 0


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["kel", "mor", "tis", "und"], k=rng.randint(6, 60))) + ".", "aa", rng.choice(["s", "t", None]), 1) for i in range(200)]
    rows += [(500, None, None, None, None), (501, "", "aa", "s", 0), (502, "1 2 3", "aa", "s", 5), (7, rows[7][1], "aa", "s", 1), (None, "kel mor " * 50, "aa", "t", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS)
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            counts.append(docs.count())
    assert counts[0] == len(rows) - 3 and counts[2] <= counts[1]
    assert out.select("doc_id").distinct().count() <= counts[2]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()


def stored_tables(spark, folder, rows):
    """Writes documents with clashing extra columns, and labels of the ids below 100."""
    extra = "score double, n long, dig string, size int, __key string, lang_pred string"
    data = [(*r, 0.5, 1, "d", 2, "k", "zz") for r in rows]
    spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_of_an_empty_table(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stored_tables(spark, tmp_path, [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(out.columns)


def test_pipeline_with_long_texts_repeats_and_clashing_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["kel", "mor", "tis", "und", "wek", "lun"], k=40)) + ".", "aa", "s", 1) for i in range(60)]
    long = " ".join(rng.choices(["kel", "mor", "tis", "und", "wek", "lun"], k=150_000)) + "."
    rows += [(60, long, "aa", "s", 1), *[rows[5]] * 20, *[(200 + i, rows[6][1], "aa", None, 1) for i in range(20)]]
    stored_tables(spark, tmp_path, rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length").collect()
    # one row of each group stays; the only source left meets its target with each document once
    assert {r.doc_id for r in got} == set(range(61)) and sum(r.piece == 0 for r in got) == 61
    pieces = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 60)
    assert [p for p, *_ in pieces] == list(range(len(pieces))) and all(n == 2048 for *_, n in pieces[:-1]) and len(pieces) > 50
