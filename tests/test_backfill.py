from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from factloom.operators import models

SCHEMA = "id long, media_type string, raw_text string, transcript string"


def counting(folder, fails=()):
    """An embedder that notes each text it is asked about, and fails for some."""

    def call(texts):
        for t in texts:
            with open(os.path.join(folder, "asked"), "a") as f:
                f.write(t + "\n")
            if t in fails:
                raise RuntimeError("the model went away")
        return [[float(len(t)), 1.0] for t in texts]

    return models.embedder(call)


def asked(folder):
    with open(os.path.join(folder, "asked")) as f:
        return f.read().split()


def test_a_run_that_was_killed_goes_on_without_asking_twice(spark, tmp_path):
    messages = spark.createDataFrame([(i, "text", f"text{i}" if i % 10 else None, None) for i in range(200)], SCHEMA)
    have = spark.createDataFrame([(1, [0.0])], "message_id long, vector array<float>")
    folder = str(tmp_path / "backfill")
    with pytest.raises(Exception, match="went away"):
        models.backfill(messages, have, counting(tmp_path, fails=("text77",)), folder, chunk=20)
    done = {r.message_id for r in spark.read.schema("message_id long").parquet(*[str(p.parent) for p in (tmp_path / "backfill/vectors").glob("*/_SUCCESS")]).collect()} if list((tmp_path / "backfill/vectors").glob("*/_SUCCESS")) else set()
    os.remove(tmp_path / "asked")
    more = messages.unionByName(spark.createDataFrame([(999, "text", "later", None)], SCHEMA))  # isn't in the plan
    got = models.backfill(more, have, counting(tmp_path), folder, chunk=20)
    want = {i for i in range(200) if i % 10 and i != 1}
    assert {r.message_id for r in got.collect()} == want and got.count() == len(want)
    again = asked(tmp_path)
    assert len(again) == len(set(again)) and not {f"text{i}" for i in done} & set(again) and len(again) == len(want) - len(done)
    os.remove(tmp_path / "asked")
    assert models.backfill(more, have, counting(tmp_path), folder).count() == len(want) and not os.path.exists(tmp_path / "asked")


def test_nothing_to_do(spark, tmp_path):
    messages = spark.createDataFrame([(1, "text", None, None)], SCHEMA)
    assert models.backfill(messages, messages.select(F.col("id").alias("message_id")).limit(0), counting(tmp_path), str(tmp_path / "b")).count() == 0
