"""Model output to facts: parsing, validation, trust, and storing triples in their order."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factloom import schema as S
from factloom.functions import expr as X
from factloom.functions.identity import Registry, nfc_trim
from factloom.store import keep

IMPORTANCE = 0.5
#: Names that are sent to all tasks; where there are more, triples and names meet by a shuffle.
FEW_NAMES = 100_000


def parse_output(rows: DataFrame, output: str = "output") -> DataFrame:
    """One row a triple of each row's model output (a JSON array, maybe in a code fence), with triple_seq; output that is no
    such array gives one row with parse_error."""
    rest = [c for c in rows.columns if c != output]
    kind = f"array<{S.TRIPLE.simpleString()}>"
    # one step each: a filter over the parsed array, or an inner explode, would have it parsed again
    text = rows.select(*rest, X.strip_fence(F.col(output)).alias("__text"))
    parsed = text.select(*rest, F.when(F.col("__text").startswith("["), F.from_json("__text", kind, {"mode": "PERMISSIVE"})).alias("__all"))
    each = parsed.select(*rest, F.col("__all").isNull().alias("__bad"), F.posexplode_outer("__all").alias("triple_seq", "t"))
    out = each.filter(F.col("triple_seq").isNotNull() | F.col("__bad"))
    return out.select(*rest, "triple_seq", "t.*", F.when(F.col("__bad"), "not a JSON array").alias("parse_error"))


def reject_reason() -> Column:
    """Why a triple is refused, by the first rule that it breaks; null if by none.  Both ends of the confidence range count."""
    return (
        F.when(~F.coalesce(F.col("predicate").isin(*S.PREDICATES), F.lit(False)), "unknown_predicate")
        .when(~F.coalesce(F.col("object_type").isin("entity", "literal"), F.lit(False)), "unknown_object_type")
        .when(F.coalesce(X.strip(F.col("subject")), F.lit("")) == "", "empty_subject")
        .when(F.coalesce(X.strip(F.col("object")), F.lit("")) == "", "empty_object")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence_out_of_range")
    )


def trusted_corrections(triples: DataFrame, messages: DataFrame, entities: DataFrame) -> DataFrame:
    """is_correction stays only where the message that the triple points at (in window_ids) exists and is one's own; any
    other correction becomes an ordinary claim."""
    at = F.when(F.col("is_correction") & (F.col("correction_source_index") >= 0), F.get("window_ids", F.col("correction_source_index")))
    said = messages.select(F.col("id").alias("__m"), F.col("sender_id").alias("__s"))
    own = entities.filter("is_self").select(F.col("id").alias("__s"), F.lit(True).alias("__own"))
    rows = triples.withColumn("__m", at).join(said, "__m", "left").join(own, "__s", "left")
    return rows.withColumn("is_correction", F.coalesce(F.col("is_correction") & F.col("__own"), F.lit(False))).drop("__m", "__s", "__own")


def without_corrections(triples: DataFrame) -> DataFrame:
    """What a bulk import takes by default: all corrections as ordinary claims."""
    return triples.withColumns({"is_correction": F.lit(False), "correction_source_index": F.lit(None).cast("int")})


#: One key's facts and claims in; facts that are new or changed, and outcomes, out.
FOLDED = "kind string, id string, subject_id string, predicate string, object_id string, object_literal string, confidence double, importance double, source_type string, source_weight double, source_message_ids array<string>, first_us long, last_us long, decay_locked boolean, superseded_by string, is_correction boolean, claim_id string, action string"


def _same(a_id, a_lit, b_id, b_lit) -> bool:
    if a_id is not None and b_id is not None:
        return a_id == b_id
    return a_lit is not None and a_lit == b_lit


def fold_key(facts: list[dict], claims: Iterable[dict]) -> Iterator[dict]:
    """The claims of one subject and predicate in their order; each sees what those before it did.  Live facts are found by their object
    or old value, of superseded ones only the latest time counts, so a claim costs the same after many corrections as after few."""

    def is_live(f: dict) -> bool:
        return f["superseded_by"] is None and f["source_type"] != S.USER_DELETION

    facts = sorted(facts, key=lambda f: (f["first_us"], f["id"]))
    by_object: dict[tuple, dict[str, dict]] = {}  # live facts, in order
    late: dict[tuple, int] = {}  # until when what was superseded was said
    live = {}

    def objects(x: dict) -> list[tuple]:
        return [("id", x["object_id"])] * (x["object_id"] is not None) + [("lit", x["object_literal"])] * (x["object_literal"] is not None)

    def old_values(x: dict) -> list[tuple]:
        return [("id", x["object_id"])] * (x["object_id"] is not None) + ([("old", x["object_literal"].strip().lower())] if x["object_literal"] is not None else [])

    def gone(f: dict) -> None:
        """Takes note of a superseded fact; a literal without an entity is also like that of a claim with one."""
        for k in objects(f) + [("alone", f["object_literal"])] * (f["object_id"] is None and f["object_literal"] is not None):
            if f["until"] is not None:
                late[k] = max(late.get(k, f["until"]), f["until"])

    def add(f: dict) -> dict:
        if is_live(f):
            for k in {*objects(f), *old_values(f)}:
                by_object.setdefault(k, {})[f["id"]] = f
            live[f["id"]] = f
        elif f["superseded_by"] is not None:
            gone(f)
        return f

    def same(c: dict) -> list[dict]:
        return [f for k in objects(c) for f in by_object.get(k, {}).values() if _same(f["object_id"], f["object_literal"], c["object_id"], c["object_literal"])]

    def is_stale(c: dict) -> bool:
        keys = [("lit", c["object_literal"])] if c["object_id"] is None else [("id", c["object_id"]), ("alone", c["object_literal"])]
        return any(k in late and c["last_us"] <= late[k] for k in keys)

    for f in facts:
        add(f)

    def make(c: dict, correction: bool) -> dict:
        weight = 1.0 if correction else S.SOURCE_WEIGHTS[c["source_type"]]
        first, last = (c["at_us"], c["at_us"]) if correction else (c["first_us"], c["last_us"])
        new = {
            "id": str(uuid.uuid5(X.NAMESPACE, f"edge:{c['claim_id']}")), "subject_id": c["subject_id"], "predicate": c["predicate"], "object_id": c["object_id"], "object_literal": c["object_literal"],
            "confidence": 1.0 if correction else c["confidence"] * weight, "importance": IMPORTANCE, "source_type": S.USER_CORRECTION if correction else c["source_type"], "source_weight": weight,
            "source_message_ids": c["source_message_ids"] or [], "first_us": first, "last_us": last, "decay_locked": correction, "superseded_by": None, "is_correction": correction, "until": c["last_us"], "changed": True,
        }
        facts.append(new)
        return add(new)

    def reinforce(f: dict, first: int, last: int) -> str:
        f["last_us"], f["first_us"], f["changed"] = max(f["last_us"], last), min(f["first_us"], first), True
        return "reinforced"

    def correct(c: dict) -> str:
        if not live:
            return "skipped_no_correction_target"
        for f in same(c):
            return reinforce(f, c["at_us"], c["at_us"])
        targets = live
        if (c["replaces_object"] or "").strip():
            wanted = [("old", c["replaces_object"].strip().lower())] + [("id", c["replaces_id"])] * (c["replaces_id"] is not None)
            targets = {i: f for k in wanted for i, f in by_object.get(k, {}).items()}
            if not targets:
                return "skipped_no_correction_target"
        if len(targets) > 1:
            return "skipped_ambiguous_correction_target"
        (old,) = targets.values()
        new = make(c, True)
        new["importance"] = old["importance"]
        old["superseded_by"], old["changed"], old["until"] = new["id"], True, new["until"]
        del live[old["id"]]
        for k in {*objects(old), *old_values(old)}:
            del by_object[k][old["id"]]
        gone(old)
        return "corrected"

    def claim(c: dict) -> str:
        for f in same(c):
            return reinforce(f, c["first_us"], c["last_us"])
        if is_stale(c):
            return "skipped_stale"
        make(c, False)
        return "created"

    for c in claims:
        yield {"kind": "outcome", "claim_id": c["claim_id"], "action": correct(c) if c["is_correction"] else claim(c)}
    yield from ({"kind": "edge", **{k: v for k, v in f.items() if k not in ("until", "changed")}} for f in facts if f.get("changed"))


def _ids_by_name(entities: DataFrame) -> DataFrame:
    """k (the name in lower case) and the smallest id that bears it."""
    return entities.groupBy(F.lower("canonical_name").alias("k")).agg(F.min("id").cast("string").alias("id"))


def resolve_names(triples: DataFrame, entities: DataFrame, own_names: tuple[str, ...] | Registry = ()) -> tuple[DataFrame, DataFrame]:
    """Subjects and objects of extracted triples as entities: the triples with subject_id, object_id, object_literal and
    replaces_id, and the entities to add (id, type, canonical_name).

    triples: window_seq, triple_seq, subject, predicate, object, object_type, and maybe replaces_object.  A name (in either case,
    its letters composed or not) that is one's own (name, alias, identity) is the self entity, whoever else bears it.  An unknown
    name becomes an entity with the type that its first use asks for: a person as subject, by predicate as object.  The value
    that a correction replaces is looked up only: replaces_id is the entity with that name, or null, and none is made for it.
    Ids are strings; equal names give equal ids in every run.
    """
    registry = own_names if isinstance(own_names, Registry) else Registry("", tuple(own_names))
    me = entities.filter("is_self").orderBy("id").limit(1).select("id").scalar()
    uses = triples.select("window_seq", "triple_seq", F.inline(F.array(F.struct(F.lit(0).alias("place"), F.col("subject").alias("name"), F.lit("person").alias("type")), F.struct(F.lit(1).alias("place"), F.when(F.col("object_type") == "entity", F.col("object")).alias("name"), X.object_entity_type(F.col("predicate")).alias("type")))))
    # of each name its first use is all that counts, so triples are aggregated before anything is joined
    first = keep(uses.filter("name IS NOT NULL").groupBy("name").agg(F.min(F.struct("window_seq", "triple_seq", "place", "type")).alias("first")))
    own = keep(first.select("name").filter(registry.is_self_name(F.col("name"))).select("name", F.lit(True).alias("own")))
    named = first.join(own, "name", "left_anti").withColumn("k", F.lower("name"))
    have = _ids_by_name(entities)
    new = named.join(have, "k", "left_anti").groupBy("k").agg(F.min_by("name", "first").alias("canonical_name"), F.min("first")["type"].alias("type"))
    new = keep(new.withColumn("id", X.uuid5(F.concat(F.lit("entity:"), F.col("k")))))
    replaced = F.nullif(X.strip(F.col("replaces_object")), F.lit("")) if "replaces_object" in triples.columns else F.lit(None).cast("string")
    asked = first.select(F.lower("name").alias("k")).union(triples.select(F.lower(replaced).alias("k")).distinct()).distinct()
    ids = keep(have.unionByName(new.select("k", "id")).join(asked, "k", "left_semi"))
    few = first.count() + ids.count() <= FEW_NAMES  # else every join would shuffle all triples
    sent = F.broadcast if few else lambda df: df

    def looked_up(rows: DataFrame, name: str, out: str) -> DataFrame:
        return rows.join(sent(ids.select(F.col("k").alias(name), F.col("id").alias(out))), name, "left")

    def mine(rows: DataFrame, name: str, out: str) -> DataFrame:
        return rows.join(sent(own.select(F.col("name").alias(name), F.col("own").alias(out))), name, "left")

    rows = triples.withColumns({"__s": F.lower("subject"), "__o": F.when(F.col("object_type") == "entity", F.lower("object")), "__r": F.lower(replaced), "__on": F.when(F.col("object_type") == "entity", F.col("object")), "__sn": F.col("subject")})
    for name in ("__s", "__o", "__r"):
        rows = looked_up(rows, name, f"{name}_id")
    rows = mine(mine(rows, "__sn", "__s_own"), "__on", "__o_own")
    rows = rows.withColumns({
        "subject_id": F.when(F.col("__s_own"), me.cast("string")).otherwise(F.col("__s_id")),
        "object_id": F.when(F.col("object_type") == "entity", F.when(F.col("__o_own"), me.cast("string")).otherwise(F.col("__o_id"))),
        "object_literal": F.when(F.col("object_type") != "entity", F.col("object")),
        "replaces_id": F.col("__r_id"),
    })
    return rows.select(*triples.columns, "subject_id", "object_id", "object_literal", "replaces_id"), new.select("id", "type", "canonical_name")


KEY = ["subject_id", "predicate"]


def _alive() -> Column:
    return F.col("superseded_by").isNull() & (F.col("source_type") != S.USER_DELETION)


def _order() -> Column:
    return F.struct("window_seq", "triple_seq", "claim_id")


def _object(otherwise: str) -> Column:
    """What tells objects of a key apart; a row without object is like no other."""
    return F.coalesce(F.concat(F.lit("e"), "object_id"), F.concat(F.lit("l"), "object_literal"), F.concat(F.lit("n"), otherwise))


def _made(claims: DataFrame, correction: bool, first: Column, last: Column, importance: Column) -> DataFrame:
    """The facts that claims make, as rows of a state."""
    weight = F.lit(1.0) if correction else X.source_weight(F.col("source_type"))
    given = {
        "id": X.uuid5(F.concat(F.lit("edge:"), "claim_id")), "confidence": F.lit(1.0) if correction else F.col("confidence") * weight, "importance": importance,
        "source_type": F.lit(S.USER_CORRECTION) if correction else F.col("source_type"), "source_weight": weight, "first_us": first, "last_us": last, "decay_locked": F.lit(correction),
        "superseded_by": F.lit(None).cast("string"), "is_correction": F.lit(correction), "until": F.lit(None).cast("long"), "changed": F.lit(True),
        "pos": F.struct(F.lit(1).alias("new"), F.col("window_seq").cast("long").alias("a"), F.col("triple_seq").cast("long").alias("b"), F.col("claim_id").alias("c")),
    }
    return claims.select(*[given.get(c, F.col(c)).alias(c) for c in STATE])


#: Columns of the facts of some keys between two rounds.  until: when what superseded it was said; pos: which of equal facts is first.
STATE = ["id", *KEY, "object_id", "object_literal", "confidence", "importance", "source_type", "source_weight", "source_message_ids", "first_us", "last_us", "decay_locked", "superseded_by", "is_correction", "until", "changed", "pos"]


def _reinforced(state: DataFrame, seen: DataFrame) -> DataFrame:
    """state with the times of facts (id, lo, hi)."""
    rows = state.join(seen, "id", "left")
    return rows.withColumns({"first_us": F.least("first_us", "lo"), "last_us": F.greatest("last_us", "hi"), "changed": F.col("changed") | F.col("hi").isNotNull()}).select(*STATE)


def fold_objects(state: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ordinary claims of keys that no correction comes between: the new state, and claim_id with action.

    Claims about different objects of a key don't touch each other, and of those about one object only this counts: whether a live
    fact holds it, and which claim is the first that was said after all that superseded it.  All of that adds up in any order, so
    neither a key nor an object is a sequence.
    """
    by = [*KEY, "o"]
    known = state.withColumn("o", _object("id")).groupBy(*by).agg(F.min(F.when(_alive(), F.struct("pos", "id")))["id"].alias("live_id"), F.max(F.when(F.col("superseded_by").isNotNull(), F.col("until"))).alias("late"))
    c = claims.withColumn("o", _object("claim_id")).join(known, by, "left")
    fresh = F.col("live_id").isNull() & (F.col("late").isNull() | (F.col("last_us") > F.col("late")))
    first = c.groupBy(*by).agg(F.min(F.when(fresh, _order())).alias("made"))
    stale = F.col("live_id").isNull() & (F.col("made").isNull() | (_order() < F.col("made")))
    action = F.when(stale, "skipped_stale").when(F.col("live_id").isNull() & (_order() == F.col("made")), "created").otherwise("reinforced")
    judged = keep(c.join(first, by).withColumn("action", action).drop("made", "late"))
    seen = judged.filter("action <> 'skipped_stale'").groupBy(*by).agg(F.first("live_id").alias("live_id"), F.min("first_us").alias("lo"), F.max("last_us").alias("hi"))
    new = judged.filter("action = 'created'").join(seen.select(*by, "lo", "hi"), by)
    out = _reinforced(state, seen.filter("live_id IS NOT NULL").select(F.col("live_id").alias("id"), "lo", "hi"))
    return out.unionByName(_made(new, False, F.col("lo"), F.col("hi"), F.lit(IMPORTANCE))), judged.select("claim_id", "action")


def correct_once(state: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One correction for each of some keys: the new state, and claim_id with action."""
    c = corrections.withColumn("__old", F.lower(X.strip("replaces_object")))
    one = c.select(*KEY, F.col("object_id").alias("c_id"), F.col("object_literal").alias("c_lit"), "__old", F.col("replaces_id").alias("c_rep"))
    held = state.filter(_alive()).join(one, KEY)
    same = X.same_object(F.col("object_id"), F.col("object_literal"), F.col("c_id"), F.col("c_lit"))
    stated = F.coalesce(F.col("__old") != "", F.lit(False))
    hit = ~stated | F.coalesce(F.lower(X.strip("object_literal")) == F.col("__old"), F.lit(False)) | F.coalesce(F.col("object_id") == F.col("c_rep"), F.lit(False))
    found = held.groupBy(*KEY).agg(F.count("*").alias("live"), F.min(F.when(same, F.struct("pos", "id")))["id"].alias("same_id"), F.count_if(hit).alias("hits"), F.min(F.when(hit, F.struct("id", "importance"))).alias("target"))
    action = (
        F.when(F.col("live").isNull(), "skipped_no_correction_target")
        .when(F.col("same_id").isNotNull(), "reinforced")
        .when(F.col("hits") == 0, "skipped_no_correction_target")
        .when(F.col("hits") > 1, "skipped_ambiguous_correction_target")
        .otherwise("corrected")
    )
    judged = keep(c.join(found, KEY, "left").withColumn("action", action))
    done = judged.filter("action = 'corrected'")
    gone = done.select(F.col("target.id").alias("id"), X.uuid5(F.concat(F.lit("edge:"), "claim_id")).alias("by"), F.col("last_us").alias("said"))
    out = _reinforced(state, judged.filter("action = 'reinforced'").select(F.col("same_id").alias("id"), F.col("at_us").alias("lo"), F.col("at_us").alias("hi")))
    out = out.join(gone, "id", "left").withColumns({"superseded_by": F.coalesce("by", "superseded_by"), "until": F.coalesce("said", "until"), "changed": F.col("changed") | F.col("by").isNotNull()}).select(*STATE)
    return out.unionByName(_made(done, True, F.col("at_us"), F.col("at_us"), F.col("target.importance"))), judged.select("claim_id", "action")


def fold_rounds(facts: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `fold_key` does for each key, side by side: the facts that changed (columns of STATE), and claim_id with action.

    A key's corrections are barriers.  The ordinary claims before the next one are folded by object, then it is applied; there are as
    many rounds as the key with most corrections has, and one more.
    """
    state = keep(facts.withColumns({"changed": F.lit(False), "pos": F.struct(F.lit(0).alias("new"), F.col("first_us").alias("a"), F.lit(0).cast("long").alias("b"), F.col("id").alias("c"))}).select(*STATE))
    barriers = keep(claims.filter("is_correction").groupBy(*KEY).agg(F.array_sort(F.collect_list(_order())).alias("barriers")))
    placed = keep(claims.join(barriers, KEY, "left").withColumn("round", F.coalesce(F.size(F.filter("barriers", lambda b: b < _order())), F.lit(0))).drop("barriers"))
    most = barriers.agg(F.max(F.size("barriers"))).first()[0] or 0
    outcomes = None
    for k in range(most + 1):
        for kind, step in ((False, fold_objects), (True, correct_once)):
            part = placed.filter((F.col("round") == k) & (F.col("is_correction") == F.lit(kind)))
            state, done = step(state, part)
            outcomes = done if outcomes is None else outcomes.unionByName(done)
            if most:
                state = keep(state)  # else the plan would grow with each round
    return state.filter("changed"), outcomes


def store_triples(edges: DataFrame, claims: DataFrame, messages: DataFrame, as_of: str, unit: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Stores resolved claims.  The claims of one subject and predicate count in order; all keys go side by side.

    Keys go through `fold_key`, which reads their claims in order and holds their facts only.  Those of more than `unit` claims and
    facts for each of their corrections are no sequence in one task: between corrections they are folded by object, as aggregates
    (see `fold_rounds`).  A round takes several jobs, so a key with more corrections than that stays a sequence.  claims: claim_id, window_seq, triple_seq, subject_id, predicate, object_id, object_literal, confidence, is_correction,
    replaces_object, replaces_id, source_type, source_message_ids, and maybe correction_source_index.  Times are those of the
    source messages, none after now; those of a correction are its one message's, to which the index points in
    source_message_ids (the window's first and last, if there is no such message).  Returns the edges with all changes, and
    claim_id with its action.  Ids are strings.
    """
    now = X.as_of_micros(as_of)
    at = messages.select(F.col("id").alias("m"), F.least(X.micros(F.col("timestamp")), now).alias("us"))
    seen = claims.select("claim_id", F.explode("source_message_ids").alias("m")).join(at, "m").groupBy("claim_id").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    index = F.col("correction_source_index") if "correction_source_index" in claims.columns else F.lit(None).cast("int")
    pointed = claims.withColumn("__m", F.when(index >= 0, F.get("source_message_ids", index))).join(at.toDF("__m", "at_us"), "__m", "left").drop("__m")
    timed = pointed.join(seen, "claim_id", "left").withColumns({"first_us": F.coalesce("first_us", now), "last_us": F.coalesce("last_us", now)}).withColumn("at_us", F.coalesce("at_us", "first_us"))
    # which way a key takes: only keys that have claims are folded
    asked = claims.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if("is_correction").alias("c"))
    held = edges.join(asked.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("m"))
    rows = F.col("n") + F.coalesce("m", F.lit(0))
    keys = keep(asked.join(held, KEY, "left").select(*KEY, (rows > unit * (F.col("c") + 1)).alias("wide")))
    wide = not keys.filter("wide").isEmpty()
    hold = keep if wide else lambda df: df  # read twice only then
    marked = keys.select(*KEY, "wide")
    timed = hold(timed.join(marked, KEY) if wide else timed.withColumn("wide", F.lit(False)))
    # of the superseding facts, which may have another key, the time alone is needed
    touched = edges.join(marked, KEY)
    needed = touched.filter("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("id")).distinct()
    ends = edges.select("id", "first_seen", "source_message_ids").join(needed, "id", "left_semi")
    by = ends.select(F.col("id").alias("superseded_by"), F.least(X.micros(F.col("first_seen")), now).alias("seen"))
    src = ends.select(F.col("id").alias("superseded_by"), F.explode("source_message_ids").alias("m")).join(at, "m").groupBy("superseded_by").agg(F.max("us").alias("latest"))
    until = by.join(src, "superseded_by", "left").select("superseded_by", F.coalesce("latest", "seen").alias("until"))
    facts = hold(touched.join(until, "superseded_by", "left").withColumns({"first_us": X.micros(F.col("first_seen")), "last_us": X.micros(F.col("last_reinforced"))}))

    names = [c.split()[0] for c in FOLDED.split(", ")]
    own = [c for c in names if c not in ("kind", "claim_id", "action")]
    folded = keep(_fold_tasks(facts.filter("NOT wide"), timed.filter("NOT wide")))
    changed = folded.filter("kind = 'edge'").select(*own)
    outcomes = folded.filter("kind = 'outcome'").select("claim_id", "action")
    if wide:
        large, done = fold_rounds(facts.filter("wide"), timed.filter("wide"))
        changed, outcomes = keep(changed.unionByName(large.select(*own))), outcomes.unionByName(done)
    rate = X.default_decay_rate(F.col("predicate"))
    as_time = {"first_seen": F.timestamp_micros("first_us"), "last_reinforced": F.timestamp_micros("last_us"), "decay_rate": rate}
    new = changed.select(*[as_time.get(f.name, F.col(f.name) if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in edges.schema])
    return edges.join(new.select("id"), "id", "left_anti").select(*edges.columns).unionByName(new), outcomes


def _fold_tasks(facts: DataFrame, claims: DataFrame) -> DataFrame:
    """`fold_key` for all keys, each in one partition and in order there: rows of FOLDED."""
    names, columns = [c.split()[0] for c in FOLDED.split(", ")], to_arrow_schema(StructType.fromDDL(FOLDED))

    def packed(some: list[dict], filled: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in some], f.type) if f.name in filled else pa.nulls(len(some), f.type) for f in columns], schema=columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def folded() -> Iterator[dict]:
            for _, one in groupby((r for b in batches for r in b.to_pylist()), lambda r: (r["subject_id"], r["predicate"])):
                held, first = [], None
                for r in one:  # facts come before claims
                    if r["claim_id"] is not None:
                        first = r
                        break
                    held.append(r | {"source_message_ids": r["source_message_ids"] or []})
                yield from fold_key(held, one if first is None else chain([first], one))

        out = folded()
        while some := list(islice(out, 10_000)):
            done = [r for r in some if r["kind"] == "outcome"]
            yield packed(done, ["kind", "claim_id", "action"])
            if len(done) < len(some):
                yield packed([r for r in some if r["kind"] == "edge"], names)

    left = facts.select(*KEY, *[c for c in names if c in facts.columns and c not in KEY], "until")
    asked = ["claim_id", "window_seq", "triple_seq", *KEY, "object_id", "object_literal", "confidence", "is_correction", "replaces_object", "replaces_id", "source_type", "source_message_ids", "first_us", "last_us", "at_us"]
    rows = left.unionByName(claims.select(*asked), allowMissingColumns=True)
    order = [*KEY, F.col("claim_id").isNotNull(), "window_seq", "triple_seq", "claim_id"]
    return rows.repartition(*KEY).sortWithinPartitions(*order).mapInArrow(fold, FOLDED)


def store_extracted(windows: DataFrame, edges: DataFrame, entities: DataFrame, messages: DataFrame, own_names: tuple[str, ...] | Registry, as_of: str, batch: str = "", corrections: bool = True, unit: int = 20_000) -> dict[str, DataFrame]:
    """From what a model said of each window to stored facts, in one call.

    windows: window_seq, window_ids (its messages, in order), source_type, output.  Output is parsed; triples that break a rule are
    refused, each by itself; a correction counts only where the message that it points at is one's own, else it is an ordinary
    claim (all are, unless `corrections`); names become entities; claims are stored in order of window and triple.  Returns
    edges and entities as they are then, outcomes (window_seq, triple_seq, claim_id, action), and refused (window_seq,
    triple_seq, reason: a rule, or parse_error for a window whose output is no list, with null triple_seq).  Facts get their ids from
    `batch`, window and triple.  Ids are strings; a row or table without anything to store changes nothing.
    """
    parsed = parse_output(windows.select("window_seq", F.col("window_ids").cast("array<string>").alias("window_ids"), "source_type", "output"))
    parsed = keep(parsed.withColumn("reason", F.when(F.col("parse_error").isNotNull(), "parse_error").otherwise(reject_reason())))
    good = parsed.filter("reason IS NULL").drop("reason", "parse_error")
    ids = {"id": F.col("id").cast("string"), "sender_id": F.col("sender_id").cast("string")}
    people = entities.withColumn("id", F.col("id").cast("string"))
    trusted = trusted_corrections(good, messages.withColumns(ids), people) if corrections else without_corrections(good)
    rows, new = resolve_names(trusted, people, own_names)
    claim = F.concat_ws(":", F.lit(batch), F.col("window_seq").cast("string"), F.col("triple_seq").cast("string"))
    claims = keep(rows.withColumn("claim_id", claim).withColumnRenamed("window_ids", "source_message_ids"))
    new = keep(new)
    stored, outcomes = store_triples(edges, claims, messages.select(ids["id"].alias("id"), "timestamp"), as_of, unit)
    made = {"id": F.col("id"), "type": F.col("type"), "canonical_name": F.col("canonical_name"), "is_self": F.lit(False), "created_at": F.lit(as_of), "updated_at": F.lit(as_of)}
    added = new.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in people.schema])
    return {
        "edges": stored,
        "entities": people.unionByName(added),
        "outcomes": claims.select("window_seq", "triple_seq", "claim_id").join(outcomes, "claim_id").select("window_seq", "triple_seq", "claim_id", "action"),
        "refused": parsed.filter("reason IS NOT NULL").select("window_seq", "triple_seq", "reason"),
    }
