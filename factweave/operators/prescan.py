"""Journal pre-scan: bodies, roots of reinterpretations, retractions, states and the effective stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factweave import constants as K, schema
from factweave.functions import identifiers as ids, text
from factweave.scratch import materialize

#: Doublings of the pointer to the parent. A chain has fewer events than 2 ** ROUNDS, so pointers that still move go in a circle.
ROUNDS = 63


class Refused(ValueError):
    """The journal breaks a rule; the argument names it."""


def parsed(journal: DataFrame) -> DataFrame:
    """The journal with each body as a column b of one explicit type; a journal that has it already stays as it is."""
    return journal if "b" in journal.columns else journal.withColumn("b", F.from_json("body", schema.BODY))


def body_violations(journal: DataFrame) -> DataFrame:
    """(seq, id, problem) of rows that the model refuses; empty for a valid journal. Bodies are checked by the keys that they have."""
    j = parsed(journal).withColumn("keys", F.json_object_keys("body"))
    keys = lambda *names: F.array_sort(F.array(*map(F.lit, names)))
    got = F.array_sort("keys")
    statement = (got == keys("raw_text", "parsed", "provenance", "ttl")) | (got == keys("raw_text", "parsed", "provenance", "ttl", "supersedes"))
    noted = lambda *names: (got == keys(*names)) | (got == keys(*names, "note"))
    target_keys = F.array_sort(F.json_object_keys(F.get_json_object("body", "$.target")))
    draft_bad = F.exists(
        "b.parsed",
        lambda d: d["subject"].isNull() | ~F.coalesce(d["relation"].isin(*K.PREDICATES), F.lit(False)) | (d["object"].isNull() == d["object_value"].isNull()) | ((d["relation"] == K.LABELLED) & F.coalesce(F.trim(d["relation_label"]) == "", F.lit(True))),
    )
    target_event = F.col("b.target.event_id")
    of = journal.select(F.col("id").alias("t_id"), F.col("kind").alias("t_kind"), F.col("seq").alias("t_seq"), F.col("scope_key").alias("t_scope"))
    j = j.join(of, target_event == F.col("t_id"), "left")
    twice = journal.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id", F.lit(True).alias("twice"))
    j = j.join(twice, "id", "left")
    size = F.coalesce(F.size("b.parsed"), F.lit(-1))
    problem = (
        F.when(F.col("twice"), "DUPLICATE_EVENT_ID")
        .when(~F.col("id").rlike(K.EVENT_ID), "INVALID_EVENT_ID")
        .when(~F.col("scope_key").rlike(K.SCOPE_KEY), "INVALID_SCOPE_KEY")
        .when(F.col("keys").isNull(), "INVALID_JSON_BODY")
        .when(~F.col("kind").isin(*K.KINDS), "INVALID_KIND")
        .when((F.col("kind") == "statement") & ~statement, "INVALID_BODY_KEYS")
        .when((F.col("kind") == "statement") & ((size < 0) | (size > K.CLAIMS)), "INVALID_DRAFTS")
        .when((F.col("kind") == "statement") & ~(F.col("b.provenance").isin(*K.PROVENANCE_RANK) & F.col("b.ttl").isin(*K.TTL)), "INVALID_ENUM")
        .when((F.col("kind") == "statement") & F.coalesce(draft_bad, F.lit(False)), "INVALID_DRAFT")
        .when((F.col("kind") == "merge") & ~noted("keep", "absorb"), "INVALID_BODY_KEYS")
        .when((F.col("kind") == "alias") & ~noted("surface", "entity_id"), "INVALID_BODY_KEYS")
        .when((F.col("kind") == "retraction") & ~noted("target"), "INVALID_BODY_KEYS")
        .when((F.col("kind") == "retraction") & ~(target_keys == keys("claim_id")) & ~(target_keys == keys("event_id")) & ~(target_keys == keys("cascade", "event_id")), "INVALID_TARGET")
        .when(target_event.isNotNull() & (F.col("t_id").isNull() | (F.col("t_scope") != F.col("scope_key")) | (F.col("t_seq") >= F.col("seq"))), "TARGET_NOT_FOUND")
        .when(target_event.isNotNull() & (F.col("t_kind") == "retraction"), "TARGET_IS_RETRACTION")
        .when((F.col("t_kind") == "statement") & F.col("b.target.cascade").isNull(), "CASCADE_MISSING")
        .when(F.col("t_kind").isin("merge", "alias") & F.col("b.target.cascade").isNotNull(), "CASCADE_FORBIDDEN")
    )
    return j.select("seq", "id", problem.alias("problem")).where("problem is not null")


def roots(journal: DataFrame) -> DataFrame:
    """(scope_key, id, seq, parent, root_id, root_seq) of statements.

    Only reinterpretations have a parent. Their pointers are doubled and written
    in each round, until all point to roots: a chain takes a logarithm of rounds.
    """
    s = parsed(journal.where("kind = 'statement'")).select("scope_key", "id", "seq", F.col("b.supersedes").alias("parent"))
    moving = materialize(s.where("parent is not null").select("scope_key", "id", F.col("parent").alias("up")), "roots")
    if moving.isEmpty():
        return s.select("scope_key", F.col("id").alias("root_id"), "id", "seq", "parent", F.col("seq").alias("root_seq"))
    for _ in range(ROUNDS):
        far = moving.select("scope_key", F.col("id").alias("up"), F.col("up").alias("far"))
        step = materialize(moving.join(far, ["scope_key", "up"], "left").select("scope_key", "id", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("moved")), "roots")
        moving = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    else:
        raise Refused("SUPERSEDES_CYCLE")
    s = s.join(moving.withColumnRenamed("up", "root_id"), ["scope_key", "id"], "left").withColumn("root_id", F.coalesce("root_id", "id"))
    top = s.select("scope_key", F.col("id").alias("root_id"), F.col("seq").alias("root_seq"))
    return s.join(top, ["scope_key", "root_id"])


def statement_states(journal: DataFrame) -> DataFrame:
    """(scope_key, id, seq, root_id, root_seq, state): retracted before superseded before live.

    A cascading retraction takes the whole chain as it was then; one without
    cascade takes one event, and its parent lives again.
    """
    r = materialize(roots(journal), "roots")
    gone = parsed(journal.where("kind = 'retraction'")).where("b.target.event_id is not null").select("scope_key", F.col("seq").alias("r_seq"), F.col("b.target.event_id").alias("id"), F.coalesce("b.target.cascade", F.lit(False)).alias("cascade"))
    direct = gone.select("scope_key", "id")
    whole = gone.where("cascade").join(r.select("scope_key", "id", "root_id"), ["scope_key", "id"]).groupBy("scope_key", "root_id").agg(F.max("r_seq").alias("r_seq"))
    chain = r.join(whole, ["scope_key", "root_id"]).where("seq < r_seq").select("scope_key", "id")
    dead = direct.union(chain).distinct().withColumn("dead", F.lit(True))
    r = r.join(dead, ["scope_key", "id"], "left")
    child = r.where("parent is not null and dead is null").select("scope_key", F.col("parent").alias("id"), F.lit(True).alias("child")).distinct()
    state = F.when(F.col("dead"), "retracted").when(F.col("child"), "superseded").otherwise("live")
    return r.join(child, ["scope_key", "id"], "left").select("scope_key", "id", "seq", "root_id", "root_seq", state.alias("state"))


def expiry(created_at, ttl, provenance):
    """(effective ttl, end of the lifetime or null)."""
    default = F.lit(None).cast("string")
    for k, v in K.DEFAULT_TTL.items():
        default = F.when(provenance == k, v).otherwise(default)
    own, seconds = F.coalesce(ttl, default), F.lit(None).cast("long")
    for k, v in K.TTL.items():
        seconds = F.when(own == k, F.lit(v).cast("long")).otherwise(seconds)
    return own, created_at + seconds


def statements(journal: DataFrame) -> DataFrame:
    """Statements with state, and order, time, provenance and lifetime from the root; drafts are their own."""
    p = parsed(journal.where("kind = 'statement'"))
    own = p.select("scope_key", "id", F.col("b.raw_text").alias("raw_text"), F.col("b.parsed").alias("parsed"), F.col("created_at").alias("recorded_at"))
    top = p.select("scope_key", F.col("id").alias("root_id"), "created_at", F.col("b.provenance").alias("provenance"), F.col("b.ttl").alias("ttl"))
    s = statement_states(journal).join(own, ["scope_key", "id"]).join(top, ["scope_key", "root_id"])
    return s.withColumn("expires_at", expiry(F.col("created_at"), F.col("ttl"), F.col("provenance"))[1]).withColumnRenamed("root_seq", "order_seq")


def decisions(journal: DataFrame) -> DataFrame:
    """Merges and aliases that no retraction undoes."""
    j = parsed(journal)
    undone = j.where("kind = 'retraction' and b.target.event_id is not null").select("scope_key", F.col("b.target.event_id").alias("id")).distinct()
    return j.where("kind in ('merge', 'alias')").join(undone, ["scope_key", "id"], "left_anti")


def effective_stream(journal: DataFrame) -> DataFrame:
    """(scope_key, id, kind, order_seq, seq): live statements at their root's place, claim retractions, and decisions that stand."""
    live = statement_states(journal).where("state = 'live'").select("scope_key", "id", F.lit("statement").alias("kind"), F.col("root_seq").alias("order_seq"), "seq")
    j, decided = journal, decisions(journal)
    other = j.where("kind = 'retraction'").select("scope_key", "id", "kind", F.col("seq").alias("order_seq"), "seq").unionByName(decided.select("scope_key", "id", "kind", F.col("seq").alias("order_seq"), "seq"))
    return live.unionByName(other)


def event_violations(journal: DataFrame) -> DataFrame:
    """(id, problem): ids that repeat, and retractions whose target is no earlier event of the scope, or a retraction."""
    j = parsed(journal)
    twice = j.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("DUPLICATE_EVENT_ID").alias("problem"))
    r = j.where("b.target.event_id is not null").select("id", "seq", "scope_key", F.col("b.target.event_id").alias("t_id"))
    of = j.select(F.col("id").alias("t_id"), F.col("kind").alias("t_kind"), F.col("seq").alias("t_seq"), F.col("scope_key").alias("t_scope"))
    problem = F.when(F.col("t_seq").isNull() | (F.col("t_scope") != F.col("scope_key")) | (F.col("t_seq") >= F.col("seq")), "TARGET_NOT_FOUND").when(F.col("t_kind") == "retraction", "TARGET_IS_RETRACTION")
    return twice.unionByName(r.join(of, "t_id", "left").select("id", problem.alias("problem")).where("problem is not null"))


def supersedes_violations(journal: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """(id, problem): a parent that is missing or not earlier, content unlike the root's, or several live leaves of one root. states: statement_states(), where they are known."""
    s = parsed(journal.where("kind = 'statement'")).select("scope_key", "id", "seq", F.col("b.supersedes").alias("parent"), F.struct("b.raw_text", "b.provenance", "b.ttl").alias("content"))
    parent = s.select("scope_key", F.col("id").alias("parent"), F.col("seq").alias("p_seq"), F.col("content").alias("p_content"))
    a = s.where("parent is not null").join(parent, ["scope_key", "parent"], "left")
    bad = a.select("id", F.when(F.col("p_seq").isNull() | (F.col("p_seq") >= F.col("seq")), "SUPERSEDES_TARGET_NOT_FOUND").when(~F.col("content").eqNullSafe(F.col("p_content")), "SUPERSEDES_CONTENT_MISMATCH").alias("problem")).where("problem is not null")
    states = statement_states(journal) if states is None else states
    leaves = states.where("state = 'live'").groupBy("scope_key", "root_id").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1")
    return bad.unionByName(leaves.select("id", F.lit("MULTIPLE_LIVE_LEAVES").alias("problem")))


def occurrences(stated: DataFrame) -> DataFrame:
    """One row for each draft of statements(), with its names' and literal's identities: position counts entity occurrences, of which a literal is none."""
    s = stated.where(F.size("parsed") > 0).select("scope_key", "id", "seq", "order_seq", "created_at", "provenance", "expires_at", "state", F.posexplode("parsed").alias("draft_index", "d"), "parsed")
    before = F.aggregate(F.slice("parsed", 1, F.col("draft_index")), F.lit(0), lambda n, d: n + F.when(d["object"].isNotNull(), 2).otherwise(1))
    names = text.normalize_name("d.subject").alias("s_norm"), text.normalize_name("d.object").alias("o_norm"), text.normalize_literal("d.object_value").alias("literal")
    return s.withColumn("position", before).select(
        "scope_key", "id", "seq", "order_seq", "created_at", "provenance", "expires_at", "state", "draft_index", "position", "d", *names,
        ids.make("e", F.col("seq"), F.col("position")).alias("subject_ref"), F.when(F.col("d.object").isNotNull(), ids.make("e", F.col("seq"), F.col("position") + 1)).alias("object_ref"), ids.make("c", F.col("seq"), F.col("draft_index")).alias("claim_ref"),
    )
