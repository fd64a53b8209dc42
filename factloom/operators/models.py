"""Model calls as injection points.  Nothing here opens a connection: callers pass functions, and tests pass fakes.

Model columns are marked non-deterministic, so that the optimizer never calls a model twice for a row.
"""

from __future__ import annotations

import gzip
import hashlib
import time
from collections.abc import Callable
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import expr as X
from factloom.store import committed, keep

THRESHOLD = -0.7
#: Bytes of a response at most; of a transcription.
RESPONSE_LIMIT, TRANSCRIPT_LIMIT = 4 << 20, 16 << 20


def embedder(call: Callable[[list[str]], list[list[float]]], prefix: str = "") -> Callable[[Column], Column]:
    """A column function from texts to vectors; documents and queries differ in prefix."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(call([prefix + (t or "") for t in texts]), index=texts.index)

    return embed.asNondeterministic()


def hash_embedding(dim: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """A fake embedder: the same text gives the same vector."""
    return lambda texts: [[b / 255 - 0.5 for b in hashlib.sha512(t.encode()).digest()[:dim]] for t in texts]


def triager(call: Callable[[str], str]) -> Callable[[Column], Column]:
    """A column function from texts or windows to whether the model calls them candidates."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: call(p or ""))

    return lambda c: is_candidate(ask.asNondeterministic()(c))


def is_candidate(response: Column) -> Column:
    return F.coalesce(F.upper(X.strip(response)).startswith("CANDIDATE"), F.lit(False))


def extract(windows: DataFrame, call: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """windows with `output`, the model's answer to each prompt."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return prompts.map(call)

    return windows.withColumn("output", ask.asNondeterministic()(F.col(prompt)))


TRANSCRIPT = "text string, language string, avg_logprob double, error string"


class Upstream(Exception):
    """A model's answer with a status that isn't a success."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


class Cancelled(Exception):
    """Nobody waits for the answer any more."""


def transcriber(call: Callable[..., dict], wait: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable[..., Column]:
    """A column function from audio (and maybe a language hint) to (text, language, avg_logprob, error).

    A server that restarts answers 502: that is tried once more after `wait` seconds.  Any other failure is kept as error at
    once; a cancelled call gives the error `cancelled`.
    """

    def one(audio: bytes, language: str | None) -> dict:
        for again in (True, False):
            try:
                got = call(audio, language) if language else call(audio)
                logs = [s["avg_logprob"] for s in got.get("segments", [])]
                return {"text": got["text"], "language": got.get("language"), "avg_logprob": sum(logs) / len(logs) if logs else 0.0, "error": None}
            except Cancelled:
                return {"error": "cancelled"}
            except Upstream as e:
                if e.status != 502 or not again:
                    return {"error": f"status {e.status}"}
                sleep(wait)
            except Exception as e:  # noqa: BLE001 - any failure of the model is data here
                return {"error": type(e).__name__}
        raise AssertionError

    @F.pandas_udf(TRANSCRIPT)
    def run(audio: pd.Series, language: pd.Series) -> pd.DataFrame:
        rows = [{"error": "no audio"} if a is None else one(bytes(a), hint) for a, hint in zip(audio, language, strict=True)]
        return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], index=audio.index, dtype=float if c == "avg_logprob" else object) for c in ("text", "language", "avg_logprob", "error")})

    udf = run.asNondeterministic()
    return lambda audio, language=None: udf(audio, F.lit(None).cast("string") if language is None else language)


def is_arabic(language: Column) -> Column:
    return F.coalesce(F.lower(F.trim(language)).isin("ar", "arabic"), F.lit(False))


def escalate(language: Column, avg_logprob: Column, threshold: float = THRESHOLD) -> Column:
    """Arabic always needs the larger model, other languages below the threshold."""
    return is_arabic(language) | F.coalesce(avg_logprob < threshold, F.lit(False))


def transcribe_with_policy(rows: DataFrame, local: Callable[..., Column], larger: Callable[..., Column], audio: str = "content", threshold: float = THRESHOLD) -> DataFrame:
    """The local model's transcript; where it failed or may be bad, the larger model's, unless that fails too.  The larger model
    is told of Arabic.  A cancelled call isn't tried elsewhere: its message stays unprocessed for a later recovery."""
    first = rows.withColumn("__a", local(F.col(audio)))
    need = (F.col("__a.error").isNotNull() & (F.col("__a.error") != "cancelled")) | escalate(F.col("__a.language"), F.col("__a.avg_logprob"), threshold)
    second = first.withColumn("__need", need).withColumn("__b", larger(F.when(F.col("__need"), F.col(audio)), F.when(is_arabic(F.col("__a.language")), F.lit("ar"))))
    use = F.col("__need") & F.col("__b.error").isNull()
    return second.withColumn("transcription", F.when(use, F.col("__b")).otherwise(F.col("__a"))).withColumn("escalated", use).drop("__a", "__b", "__need")


def segment_mean(segments: Column) -> Column:
    """Mean avg_logprob of an array of segments; 0 if it is empty."""
    total = F.aggregate(segments, F.lit(0.0), lambda s, x: s + x["avg_logprob"])
    return F.coalesce(F.try_divide(total, F.nullif(F.size(segments), F.lit(0))), F.lit(0.0))


def word_metrics(words: Column) -> Column:
    """mean and least probability over an array of words with `probability`."""
    p = F.transform(words, lambda w: w["probability"])
    return F.struct(F.coalesce(F.try_divide(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), F.nullif(F.size(p), F.lit(0))), F.lit(0.0)).alias("mean"), F.array_min(p).alias("least"))


def audio_path(folder: str, name: str) -> str:
    """The place of an audio file in an export folder; only bare names are let in."""
    if not name or PurePosixPath(name).name != name or "\\" in name or name in (".", ".."):
        raise ValueError("not a bare file name")
    return f"{folder.rstrip('/')}/{name}"


def read_bounded(data: bytes, limit: int = RESPONSE_LIMIT, encoding: str | None = None) -> bytes:
    """A response's bytes, unpacked if it is gzip by header or by its first bytes; an error beyond the limit."""
    if encoding == "gzip" or data[:2] == b"\x1f\x8b":
        with gzip.GzipFile(fileobj=__import__("io").BytesIO(data)) as f:
            data = f.read(limit + 1)
    if len(data) > limit:
        raise ValueError(f"response of more than {limit} bytes")
    return data


def summary(status: int, kind: str, body: bytes) -> str:
    """What may be logged of a response: never the body."""
    return f"status={status} type={kind} length={len(body)} sha256={hashlib.sha256(body).hexdigest()[:8]}"


def careful_embedder(call: Callable[[list[str]], list[list[float]]], prefix: str = "") -> Callable[[Column], Column]:
    """As `embedder`, but one text at a time, and a text for which the model fails gives null."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return call([prefix + (t or "")])[0]
            except Exception:  # noqa: BLE001 - any failure of the model is data here
                return None

        return texts.map(one)

    return embed.asNondeterministic()


def embed_missing(messages: DataFrame, embeddings: DataFrame, embed: Callable[[Column], Column] | None, rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
    """message_id and vector of messages with text that have none (all, if rebuild), and what happened: one row with embedded,
    already_embedded, skipped_no_text, failed.  Messages for which the embedder gives null failed; the others go on."""
    if embed is None:
        raise ValueError("an embedder is needed")
    have = embeddings.select(F.col("message_id").alias("id"), F.lit(not rebuild).alias("__have")).distinct()
    rows = messages.dropDuplicates(["id"]).join(have, "id", "left").withColumns({"__have": F.coalesce("__have", F.lit(False)), "__text": X.usable_text()})
    todo = ~F.col("__have") & F.col("__text").isNotNull()
    tried = keep(rows.select(F.col("id").alias("message_id"), "__have", "__text", F.when(todo, embed(F.when(todo, F.col("__text")))).alias("vector")))
    some = F.col("vector").isNotNull()
    counts = tried.agg(F.count_if(some).alias("embedded"), F.count_if(F.col("__have")).alias("already_embedded"), F.count_if(~F.col("__have") & F.col("__text").isNull()).alias("skipped_no_text"), F.count_if(~F.col("__have") & F.col("__text").isNotNull() & ~some).alias("failed"))
    return tried.filter(some).select("message_id", "vector"), counts


def backfill(messages: DataFrame, embeddings: DataFrame, embed: Callable[[Column], Column], folder: str, chunk: int = 100_000, rebuild: bool = False) -> DataFrame:
    """`embed_missing` in chunks that outlive the run: message_id and vector of all messages that had text and no vector (all, if
    rebuild) when the folder's first run began.

    What is to be done is written down once, dealt into chunks of about `chunk` messages by a hash.  A chunk is a job of its own and
    counts as done when its vectors are committed in the folder; a run that goes on in the same folder takes the plan that lies
    there, leaves out chunks that are done, and asks the model about no message of these again.  A message for which the embedder
    gives null has no row; it is asked again by a backfill in a new folder.  A folder belongs to one backfill at a time.
    """
    spark = messages.sparkSession
    plan, done = f"{folder}/plan", f"{folder}/vectors"
    if not committed(spark, plan):
        have = embeddings.select(F.col("message_id").alias("id")).distinct()
        rows = messages.dropDuplicates(["id"]).withColumn("text", X.usable_text()).filter("text IS NOT NULL")
        todo = keep((rows if rebuild else rows.join(have, "id", "left_anti")).select(F.col("id").alias("message_id"), "text"))
        chunks = max(1, -(-todo.count() // chunk))
        todo.withColumn("chunk", F.pmod(F.xxhash64("message_id"), F.lit(chunks)).cast("int")).repartition("chunk").write.mode("overwrite").partitionBy("chunk").parquet(plan)
    id_type = dict(messages.dtypes)["id"]
    kind = f"message_id {id_type}, vector array<float>"
    asked = spark.read.schema(f"message_id {id_type}, text string, chunk int").parquet(plan)
    todo = sorted(r.chunk for r in asked.select("chunk").distinct().collect())
    if not todo:
        return spark.createDataFrame([], kind)
    for k in todo:
        if not committed(spark, f"{done}/chunk={k}"):
            some = asked.filter(F.col("chunk") == k).select("message_id", embed(F.col("text")).alias("vector"))
            some.filter(F.col("vector").isNotNull()).write.mode("overwrite").parquet(f"{done}/chunk={k}")
    return spark.read.schema(kind).parquet(done).select("message_id", "vector")
