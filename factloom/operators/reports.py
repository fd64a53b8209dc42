"""Reports over usage rows and pipeline outcomes."""

from __future__ import annotations

import json
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.operators.analytics import relationship_stats, upper_median


def usage_rollup(usage: DataFrame, agent: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Requests, tokens, cost and priced requests of each model and path; agent and time range are optional (end excluded)."""
    rows = usage
    for c in ([F.col("agent") == agent] if agent else []) + ([F.col("ts") >= F.lit(start)] if start else []) + ([F.col("ts") < F.lit(end)] if end else []):
        rows = rows.filter(c)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "cost")]
    return rows.groupBy("model", "path").agg(F.count("*").alias("requests"), *sums, F.count_if("price_found").alias("priced"))


def usage_totals(rollup: DataFrame, months: float = 1.0) -> DataFrame:
    return rollup.groupBy("model").agg(F.sum("requests").alias("requests"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost").alias("cost"), (F.sum("cost") * months).alias("extrapolated_cost"))


def action_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(*[F.count_if(F.col("action") == a).alias(a) for a in S.ACTIONS])


def candidate_rate(windows: DataFrame) -> DataFrame:
    return windows.agg(F.count("*").alias("windows"), F.count_if("is_candidate").alias("candidates"), F.coalesce(F.try_divide(100.0 * F.count_if("is_candidate"), F.nullif(F.count("*"), F.lit(0))), F.lit(0.0)).alias("percent"))


def zero_yield(windows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Candidate windows that gave nothing."""
    return windows.filter("is_candidate").join(outcomes.select("window_id").distinct(), "window_id", "left_anti")


def distribution(df: DataFrame, c: str = "confidence") -> DataFrame:
    return df.agg(F.count(c).alias("n"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean"), F.lit(upper_median(df, c)).cast("double").alias("median"))


def outliers(df: DataFrame, c: str = "confidence", n: int = 10) -> DataFrame:
    low = df.orderBy(F.asc(c), "id").limit(n).withColumn("side", F.lit("low"))
    return low.unionByName(df.orderBy(F.desc(c), "id").limit(n).withColumn("side", F.lit("high")))


def stratified_sample(df: DataFrame, strata: str, n: int, seed: int) -> DataFrame:
    """All rows, if there are no more than n; else ceil(n / strata) rows of each stratum (all, if it has fewer), cut to n.  The
    seed and the id give the order, so the same seed gives the same rows."""
    order = F.xxhash64(F.lit(seed), F.col("id"))
    sizes = df.agg(F.count("*").alias("rows"), F.count_distinct(strata).alias("strata"), F.max(F.col(strata).isNull().cast("int")).alias("none")).first()
    if sizes.rows <= n:
        return df
    each = -(-n // max(1, sizes.strata + (sizes.none or 0)))
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(strata).orderBy(order, "id")))
    return ranked.filter(F.col("__r") <= each).orderBy(order, "id").limit(n).drop("__r")


def drop_counts(events: DataFrame, reason: str = "drop_reason") -> DataFrame:
    return events.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))


def event_counts(events: DataFrame, kind: str = "event_type", order: str = "id", most: int = 32) -> DataFrame:
    """Counts by kind; kinds after the first `most` to appear are one, (other)."""
    first = events.groupBy(kind).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    named = first.withColumn("k", F.row_number().over(Window.orderBy("first", kind)))  # kinds, not events
    return named.groupBy(F.when(F.col("k") <= most, F.col(kind)).otherwise("(other)").alias(kind)).agg(F.sum("n").alias("n"))


def tally(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def merged_runs(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def read_usage(spark: SparkSession, path: str, agent: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Usage records (Parquet) of an agent and a time range, end excluded, with the names that usage_rollup takes."""
    rows = spark.read.parquet(path).withColumnsRenamed({"timestamp_utc": "ts", "estimated_cost_usd": "cost"})
    for c in ([F.col("agent") == agent] if agent else []) + ([F.col("ts") >= F.lit(start)] if start else []) + ([F.col("ts") < F.lit(end)] if end else []):
        rows = rows.filter(c)
    return rows


def import_totals(results: DataFrame) -> DataFrame:
    """results: conversation_id, messages, windows, triples, error (null: none).  Totals over conversations; one that failed counts
    as a failure and with what it had done."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("messages", "windows", "triples")]
    return results.agg(F.count_if(F.col("error").isNull()).alias("conversations"), *sums, F.count_if(F.col("error").isNotNull()).alias("failed"))


def dry_run_report(windows: DataFrame, outcomes: DataFrame, triples: DataFrame, rejected: DataFrame, usage: DataFrame, months: float = 1.0) -> dict:
    """What a trial run shows: pipeline counts, cost by model and path, and where failures gather.  All of it is small.

    windows: window_id, is_candidate; outcomes: window_id, action; triples: id, confidence; rejected: reject_reason; usage: as
    usage_rollup takes it.
    """

    def rows(df: DataFrame) -> list[dict]:
        return [r.asDict() for r in df.collect()]

    rollup = usage_rollup(usage)
    return {
        "windows": rows(candidate_rate(windows))[0],
        "actions": rows(action_counts(outcomes))[0],
        "confidence": rows(distribution(triples))[0],
        "outliers": rows(outliers(triples).select("id", "confidence", "side")),
        "zero_yield_windows": zero_yield(windows, outcomes).count(),
        "rejected": {r["reject_reason"]: r["n"] for r in rows(tally(rejected, "reject_reason"))},
        "usage": rows(rollup.orderBy("model", "path")),
        "usage_by_model": rows(usage_totals(rollup, months).orderBy("model")),
    }


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2, sort_keys=True, default=str)


def as_markdown(report: dict) -> str:
    """The report as headed tables, a line a value; costs without a known price are marked as not measured."""
    out = ["# Trial run", ""]
    for name, value in report.items():
        out += [f"## {name.replace('_', ' ').capitalize()}", ""]
        if isinstance(value, dict):
            out += [f"- {k}: {v}" for k, v in value.items()]
        elif isinstance(value, list):
            keys = list(value[0]) if value else []
            out += ["| " + " | ".join(keys) + " |", "|" + " --- |" * len(keys)] if keys else ["none"]
            out += ["| " + " | ".join("not measured" if k == "cost" and r.get("priced") == 0 else str(r[k]) for k in keys) + " |" for r in value]
        else:
            out.append(str(value))
        out.append("")
    return "\n".join(out)


def write_report(text: str, path: str) -> None:
    """Writes a private report; never into a version-controlled folder."""
    p = Path(path).resolve()
    if subprocess.run(["git", "-C", str(p.parent), "rev-parse", "--is-inside-work-tree"], capture_output=True).returncode == 0:
        raise PermissionError("reports don't go into a repository")
    p.touch(mode=0o600)
    p.chmod(0o600)
    p.write_text(text)


SPOT_CHECK = "self_name string, contact_name string, now string, messages array<struct<sender:string,at:timestamp>>"


def spot_check(spark: SparkSession, path: str) -> DataFrame:
    """Relationship statistics of the messages in one JSON document: self_name, contact_name, now, messages (sender, at)."""
    raw = spark.read.schema(SPOT_CHECK).option("multiLine", True).json(path)
    head = raw.select("self_name", "now").first()
    rows = raw.select(F.posexplode("messages").alias("id", "m")).select(F.col("id").cast("long").alias("id"), F.lit("spot").alias("conversation_id"), F.col("m.sender").alias("sender_id"), F.col("m.at").alias("timestamp"))
    none = spark.createDataFrame([], "subject_id string, predicate string, superseded_by string, source_type string")
    return relationship_stats(rows, none, head.self_name, head.now.replace("T", " ").removesuffix("Z"))
