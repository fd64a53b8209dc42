"""Counts and relationship statistics, for all contacts in one job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import expr as X
from factloom.operators.retrieval import live
from factloom.store import keep

GROUP_SHARE = 0.25
GROUP_REPLY_SECONDS = 1800
WINDOW_DAYS = 28
NO_REPLY = -1.0


def since_days(as_of: str, days: int = WINDOW_DAYS) -> Column:
    return X.micros(F.col("timestamp")) >= X.as_of_micros(as_of) - days * X.DAY


def count_by(messages: DataFrame, *keys: str, since: Column | None = None) -> DataFrame:
    rows = messages if since is None else messages.filter(since)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def distinct_senders(messages: DataFrame) -> DataFrame:
    return messages.select("conversation_id", "sender_id").distinct()


def conversations_of(messages: DataFrame, sender) -> DataFrame:
    return messages.filter(F.col("sender_id") == F.lit(sender)).select("conversation_id").distinct()


def last_time(messages: DataFrame, *keys: str) -> DataFrame:
    return messages.groupBy(*keys).agg(F.max(X.micros(F.col("timestamp"))).alias("last"))


def exact_median(c: Column) -> Column:
    """The middle value, or the mean of the middle two; -1 without values."""
    return F.coalesce(F.median(c), F.lit(NO_REPLY))


def upper_median(df: DataFrame, c: str, most: int = 100_000) -> float | None:
    """Element n div 2 of the sorted values that aren't null; None without values.

    The range in which it lies is narrowed by approximate percentiles and exact counts until `most` values or a single one
    are left, so no task holds them all.
    """
    rows = keep(df.select(F.col(c).alias("x")).filter("x IS NOT NULL"))
    n = rows.count()
    if not n:
        return None
    at = n // 2
    while True:
        edge = F.percentile_approx("x", [max(0.0, at / n - 0.01), min(1.0, at / n + 0.01)], 1000)
        low, high = rows.agg(edge.alias("e")).first().e
        got = rows.agg(F.count_if(F.col("x") < low).alias("below"), F.count_if(F.col("x") <= high).alias("upto")).first()
        if got.below > at:  # the approximation missed it
            rows, n = rows.filter(F.col("x") < low), got.below
        elif got.upto <= at:
            rows, n, at = rows.filter(F.col("x") > high), n - got.upto, at - got.upto
        else:
            rows, n, at = rows.filter(F.col("x").between(low, high)), got.upto - got.below, at - got.below
        if low == high and got.below <= at + got.below < got.upto:
            return low
        if n <= most:
            return rows.agg(F.element_at(F.array_sort(F.collect_list("x")), at + 1)).first()[0]


def observed_times(messages: DataFrame, as_of: str, *keys: str) -> DataFrame:
    """First and last time, none after now."""
    at = F.least(X.micros(F.col("timestamp")), X.as_of_micros(as_of))
    return messages.groupBy(*keys).agg(F.min(at).alias("first"), F.max(at).alias("last"))


def unprocessed_with_text(messages: DataFrame) -> DataFrame:
    return messages.filter(~F.col("processed") & X.usable_text().isNotNull()).orderBy("conversation_id", "timestamp", "id")


def without_embedding(messages: DataFrame, embeddings: DataFrame) -> DataFrame:
    return messages.join(embeddings.select(F.col("message_id").alias("id")), "id", "left_anti")


def classify_conversations(messages: DataFrame, me) -> DataFrame:
    """kind: group with two or more others who ever wrote, one_to_one (with owner) with one; none without."""
    others = messages.filter(F.col("sender_id") != F.lit(me)).groupBy("conversation_id").agg(F.min("sender_id").alias("a"), F.max("sender_id").alias("b"))
    alone = F.col("a") == F.col("b")
    return others.select("conversation_id", F.when(alone, "one_to_one").otherwise("group").alias("kind"), F.when(alone, F.col("a")).alias("owner"))


def attributed(messages: DataFrame, kinds: DataFrame, me, as_of: str) -> DataFrame:
    """Messages of the window credited to contacts: all of a one-to-one conversation, a quarter of one's own in groups."""
    n = count_by(messages, "conversation_id", "sender_id", since=since_days(as_of)).join(kinds, "conversation_id")
    whose = F.when(F.col("kind") == "one_to_one", F.col("owner")).when(F.col("sender_id") != F.lit(me), F.col("sender_id"))
    share = F.when(F.col("kind") == "one_to_one", F.col("n")).otherwise(GROUP_SHARE * F.col("n"))
    return n.select(whose.alias("contact_id"), share.alias("x")).filter("contact_id IS NOT NULL").groupBy("contact_id").agg(F.sum("x").alias("attributed"))


def frequency(messages: DataFrame, kinds: DataFrame, me, as_of: str) -> DataFrame:
    """Each contact's credited messages over the mean of all contacts that have some."""
    rows = attributed(messages, kinds, me, as_of)
    mean = rows.agg(F.avg("attributed")).scalar()
    return rows.select("contact_id", "attributed", F.coalesce(F.try_divide("attributed", F.nullif(mean, F.lit(0.0))), F.lit(0.0)).alias("frequency"))


def reply_latencies(messages: DataFrame, kinds: DataFrame, me, as_of: str) -> DataFrame:
    """A message of mine right after another's is a reply to it: contact_id and seconds.  Late ones in groups don't count."""
    w = Window.partitionBy("conversation_id").orderBy("timestamp", "id")
    rows = messages.filter(since_days(as_of)).select("conversation_id", "sender_id", "id", "timestamp")
    rows = rows.withColumns({"before": F.lag("sender_id").over(w), "then": F.lag(X.micros(F.col("timestamp"))).over(w)})
    replies = rows.filter((F.col("sender_id") == F.lit(me)) & (F.col("before") != F.lit(me))).join(kinds, "conversation_id")
    seconds = (X.micros(F.col("timestamp")) - F.col("then")) / 1e6
    return replies.select(F.col("before").alias("contact_id"), "conversation_id", "kind", seconds.alias("seconds")).filter((F.col("kind") != "group") | (F.col("seconds") <= GROUP_REPLY_SECONDS))


def reply_speed(latencies: DataFrame) -> DataFrame:
    return latencies.groupBy("contact_id").agg(exact_median(F.col("seconds")).alias("reply_seconds"))


def recency(messages: DataFrame, kinds: DataFrame, me) -> DataFrame:
    """When each contact was last heard of: in one-to-one conversations by either side, in groups by themselves."""
    rows = last_time(messages, "conversation_id", "sender_id").join(kinds, "conversation_id")
    whose = F.when(F.col("kind") == "one_to_one", F.col("owner")).when(F.col("sender_id") != F.lit(me), F.col("sender_id"))
    return rows.select(whose.alias("contact_id"), "last").filter("contact_id IS NOT NULL").groupBy("contact_id").agg(F.max("last").alias("last"))


def explicit_signals(edges: DataFrame) -> DataFrame:
    return edges.filter(live() & F.col("predicate").isin("nickname_is", "inside_joke_ref")).groupBy(F.col("subject_id").alias("contact_id")).agg(F.count("*").alias("signals"))


def relationship_stats(messages: DataFrame, edges: DataFrame, me, as_of: str) -> DataFrame:
    """frequency, reply_speed, humor_level (0), closeness of all contacts who ever wrote or were written to."""
    if me is None:
        raise ValueError("the self entity is needed")
    kinds = classify_conversations(messages, me)
    out = recency(messages, kinds, me)
    for part in (frequency(messages, kinds, me, as_of), reply_speed(reply_latencies(messages, kinds, me, as_of)), explicit_signals(edges)):
        out = out.join(part, "contact_id", "left")
    out = out.withColumns({"frequency": F.coalesce("frequency", F.lit(0.0)), "reply_speed": F.coalesce("reply_seconds", F.lit(NO_REPLY)), "signals": F.coalesce("signals", F.lit(0)), "humor_level": F.lit(0.0)})
    return out.select("contact_id", "frequency", "reply_speed", "humor_level", "last", "signals", X.closeness(F.col("frequency"), F.col("reply_speed"), F.col("last"), F.col("signals"), as_of).alias("closeness"))


def batch_decay(edges: DataFrame, as_of: str) -> DataFrame:
    """Effective confidence of all facts that nothing supersedes, tombstones too."""
    return edges.filter(F.col("superseded_by").isNull()).select("id", X.effective_confidence(as_of).alias("effective_confidence"))


def repeated_names(entities: DataFrame, show: int = 5) -> DataFrame:
    g = entities.groupBy(F.lower("canonical_name").alias("name")).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("id")), 1, show).alias("ids"))
    return g.filter("n > 1")


RUNS = "at long, reason string"


def idle_points(messages: DataFrame, idle_seconds: int = 35 * 60, longest_seconds: int = 20 * 3600, until: str | None = None, start: str | None = None) -> DataFrame:
    """When a consolidation would run: at (seconds since 1970) and reason.

    It runs once in a stretch without messages, when that has lasted idle_seconds, and whenever longest_seconds have passed
    since the last run or the start (the first message, if not given).  Any run within a stretch uses up its idle run.  A run
    takes no time and checks are continuous.  The start counts as activity, and nothing before it does; what comes after `until`
    (the last message, if not given) doesn't count, and no run is later.  A start without any message has its runs too.

    Activity of all conversations is one series.  Spells of idle_seconds keep their first and last second, which is all that the
    rule asks for; so one task gets two rows for each spell of the whole span, however many messages there are.
    """
    at = [F.floor(X.as_of_micros(t) / 1_000_000).cast("long") if t else F.lit(None).cast("long") for t in (start, until)]
    second = F.floor(X.micros(F.col("timestamp")) / 1_000_000).cast("long")
    within = F.col("timestamp").isNotNull() & F.coalesce(second >= at[0], F.lit(True)) & F.coalesce(second <= at[1], F.lit(True))
    spells = messages.filter(within).groupBy(F.floor(second / idle_seconds).alias("spell")).agg(F.min(second).alias("a"), F.max(second).alias("b")).select("a", "b")
    bounds = messages.sparkSession.range(1).select(at[0].alias("a"), at[1].alias("b"), F.lit(True).alias("bound"))
    spells = spells.withColumn("bound", F.lit(False)).unionByName(bounds)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        spells = rows[~rows["bound"]].sort_values("a")
        begin, end = ((None if pd.isna(v) else int(v)) for v in rows.loc[rows["bound"], ["a", "b"]].iloc[0])
        last, out = None, []
        if len(spells) or (begin is not None and end is not None):
            begin = int(spells["a"].iloc[0]) if begin is None else begin
            end = int(spells["b"].iloc[-1]) if end is None else end
            last = begin
        quiet = [(int(b), int(a)) for b, a in zip([begin, *spells["b"]], [*spells["a"], end], strict=True)] if last is not None else []

        def fallbacks(before: int) -> None:
            nonlocal last
            while last + longest_seconds < before:
                last += longest_seconds
                out.append((last, "max_interval_fallback"))

        for a, b in quiet:  # from an activity to the next
            if b - a >= idle_seconds:
                fallbacks(a + idle_seconds)
                if last <= a or (last == begin and not out):
                    last = a + idle_seconds
                    out.append((last, "idle_threshold"))
        if last is not None:
            fallbacks(end)
        return pd.DataFrame(out, columns=["at", "reason"])

    return spells.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, RUNS)
