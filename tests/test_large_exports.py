from __future__ import annotations

import random

import pytest

from factloom.sources import exports
from factloom.sources import large_exports as L


def text(rng, lines):
    """Lines in an order that is mostly rising, with forged headers, notices, headers that can't be read, and bodies of lines."""
    out, minute = [], 0
    for i in range(lines):
        kind, m = rng.random(), minute
        if kind < 0.25:
            m = max(0, minute - rng.choice([1, 2, 3, 50]))
        elif kind < 0.6:
            minute += rng.choice([0, 1, 1, 5])
            m = minute
        stamp = f"{1 + m // 1440:02d}/03/2024, {m // 60 % 24:02d}:{m % 60:02d}"
        out.append(rng.choice([f"{stamp} - Ann: text {i}"] * 6 + [f"{stamp} - Bob: omitted {i}", f"[{stamp}] Bob: x", f"{stamp} - encrypted", "31/03/2024, 10:75 - Ann: unread", f"more {i}", "", f"more {i}"]))
    return "\n".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_tables_put_together_equal_the_sequence_at_every_split(seed):
    rng = random.Random(seed)
    lines = text(rng, 40).split("\n")
    opens = [e[0] for e in map(L.event, lines) if e]

    def run(state, some):
        for o in some:
            if L.accepted(state, o):
                state = o
        return state

    for cut in range(len(opens) + 1):
        before = run(L.NONE, opens[:cut])
        t = L.Table(opens[cut:])
        for entry in (before, L.NONE, L.UNREAD, before + 61 if before > L.UNREAD else before):
            end = L.at_end(t.steps, t.any, entry)
            assert (entry if end is None else opens[cut + end]) == run(entry, opens[cut:])


@pytest.mark.parametrize(("seed", "parts"), [(1, "1"), (2, "7"), (3, "16")])
def test_lines_in_many_partitions_equal_whole_files(spark, seed, parts):
    rng = random.Random(seed)
    files = [(f"f{k}", text(rng, rng.choice([0, 1, 5, 200, 900]))) for k in range(9)] + [("busy", text(rng, 1500)), ("none", "no header\nat all"), ("long", "01/03/2024, 09:00 - Ann: begin\n" + "\n".join(f"l{i}" for i in range(1200)))]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = [(f, i, line) for f, t in files for i, line in enumerate(t.removesuffix("\n").split("\n"))]
        rng.shuffle(lines)
        got = L.split_lines(spark.createDataFrame(lines, "conversation_id string, at int, line string"))
        want = exports.split_files(spark.createDataFrame(files, "conversation_id string, value string"))
        columns = ["conversation_id", "position", "date", "clock", "sender", "body", "stamp"]
        one, two = (sorted(map(tuple, x.select(*columns).collect()), key=repr) for x in (got, want))
        assert one == two and len(two) > 300
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_file_in_many_splits_gives_the_same_messages(spark, tmp_path):
    rng = random.Random(5)
    for name in ("one", "two"):
        (tmp_path / f"{name}.txt").write_text(text(rng, 700).replace("\n", "\r\n" if name == "two" else "\n") + "\n", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = sorted(map(repr, L.read_large_text_exports(spark, str(tmp_path), "Europe/Berlin").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(map(repr, exports.read_text_exports(spark, str(tmp_path), "Europe/Berlin").collect())) and len(got) > 300
