"""The incremental reducer: a stored projection and new events that only add - statements without a predecessor, and retractions of claims.

New events stand after all old ones in the effective order, so old rows change in
few ways: a claim gains or loses support, a value loses its slot, an entity gains
a kind or names. Only what the new events touch is joined; all else is carried
over. Events that change the past, and scopes whose names depend on order, need a
replay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from factweave import constants as K, schema
from factweave.functions import text
from factweave.operators import prescan, projection
from factweave.operators.prescan import Refused
from factweave.operators.projection import Prepared, Projection
from factweave.scratch import materialize


def replayed_scopes(p: Projection, new: DataFrame) -> DataFrame:
    """(scope_key) of new events' scopes that need a replay: for a reinterpretation, a retraction of an event, a decision, or an alias that is another entity's name."""
    e = prescan.parsed(new)
    changing = e.where("kind in ('merge', 'alias') or b.supersedes is not null or b.target.event_id is not null").select("scope_key")
    decided = p.id_redirects.where("reason != 'deduplicated'").select("scope_key").union(p.surface_forms.where("origin = 'confirmed'").select("scope_key"))
    drafts = e.where("kind = 'statement'").select("scope_key", F.explode("b.parsed").alias("d"))
    names = drafts.select("scope_key", F.explode(F.array("d.subject", "d.object")).alias("n")).where("n is not null").select("scope_key", text.normalize_name("n").alias("norm"))
    each = drafts.select("scope_key", F.explode(F.array(F.struct(F.col("d.subject").alias("n"), F.col("d.subject_aliases").alias("a")), F.struct(F.col("d.object").alias("n"), F.col("d.object_aliases").alias("a")))).alias("x")).where("x.a is not null")
    aliases = each.select("scope_key", text.normalize_name("x.n").alias("of"), F.explode("x.a").alias("a")).select("scope_key", text.normalize_name("a").alias("norm"), "of")
    known = p.entities.select("scope_key", F.col("id").alias("entity_id"), F.col("normal_name").alias("of"))
    stored = p.surface_forms.join(known, ["scope_key", "entity_id"]).select("scope_key", F.col("surface_norm").alias("norm"), "of")
    every = names.union(p.entities.select("scope_key", "normal_name")).distinct()
    clash = aliases.union(stored).where("norm != of").join(every, ["scope_key", "norm"]).select("scope_key")
    return changing.union(decided).union(clash).distinct().join(new.select("scope_key").distinct(), "scope_key", "left_semi")


def _claim_refs(p: Projection, resolved: DataFrame) -> DataFrame:
    """(scope_key, claim_ref, claim_id): every claim occurrence, old and new, and the claim that it is."""
    own = p.claims.select("scope_key", F.col("id").alias("claim_ref"), F.col("id").alias("claim_id"))
    led = p.id_redirects.where("kind = 'claim'").select("scope_key", F.col("old_id").alias("claim_ref"), F.col("new_id").alias("claim_id"))
    return own.unionByName(led).unionByName(resolved.select("scope_key", "claim_ref", "claim_id"))


def _found(p: Projection, steps: Prepared) -> DataFrame:
    """(scope_key, normal_name, id, name, origin_seq, own_state, old) of old and new entities; an old one's first statement lives if its name is a name."""
    named = p.surface_forms.where("origin = 'name'").select("scope_key", F.col("surface_norm").alias("normal_name"), F.col("entity_id").alias("id"), F.lit("live").alias("own_state"))
    old = p.entities.join(named, ["scope_key", "normal_name", "id"], "left").select("scope_key", "normal_name", "id", "name", "origin_seq", F.coalesce("own_state", F.lit("retracted")).alias("own_state"), F.lit(True).alias("old"))
    fresh = projection.entities_of(steps.mentioned).join(p.entities.select("scope_key", "normal_name"), ["scope_key", "normal_name"], "left_anti")
    return old.unionByName(fresh.withColumn("old", F.lit(False)))


def _resolved(p: Projection, steps: Prepared, found: DataFrame) -> DataFrame:
    """The new drafts with the claims that they state: old ones by identity, else the first of them."""
    blank = F.lit("")
    r = projection.resolved_claims(steps.drafts, found).withColumn("o", F.coalesce("object_id", blank)).withColumn("l", F.coalesce("literal", blank))
    old = p.claims.select("scope_key", "subject_id", "relation", F.coalesce("object_id", blank).alias("o"), F.coalesce("object_value", blank).alias("l"), F.col("id").alias("old_claim"), F.col("origin_seq").alias("old_origin"))
    r = r.join(old, ["scope_key", "subject_id", "relation", "o", "l"], "left").drop("o", "l")
    return r.withColumn("known", F.col("old_claim").isNotNull()).withColumn("claim_id", F.coalesce("old_claim", "claim_id")).withColumn("origin_seq", F.coalesce("old_origin", "origin_seq")).drop("old_claim", "old_origin")


def advance(p: Projection, history: DataFrame, new: DataFrame) -> Projection:
    """The projection after new events, from the one before them; history is the journal before them. replayed_scopes() must be empty for them."""
    steps = projection.prepared(new)
    found = materialize(_found(p, steps), "entities")
    resolved = materialize(_resolved(p, steps, found), "claims")
    refs = _claim_refs(p, resolved)
    if bad := projection.refusals(steps, resolved, refs).take(1):
        raise Refused(bad[0]["problem"])
    retracted = materialize(projection.retractions(steps.events, refs), "retractions")

    # supports: a retraction takes all that stand before it
    gone = p.claim_support.join(retracted, ["scope_key", "claim_id"], "left").withColumn("live", F.when(F.col("retracted_at").isNotNull(), 0).otherwise(F.col("live")).cast("int"))
    added = materialize(projection.supports(resolved, retracted), "supports")
    support = materialize(gone.select(*schema.TABLES["claim_support"].names).unionByName(added.select(*schema.TABLES["claim_support"].names)), "supports")

    # claims: the last activation or retraction decides, and of a slot the last activation
    act = F.max(F.struct("order_seq", "seq", "draft_index"))
    acts = resolved.groupBy("scope_key", "claim_id").agg(act.alias("act"), *(F.first(c).alias(c) for c in ("subject_id", "relation", "object_id", "literal", "origin_seq", "known")))
    slots = acts.where(F.col("relation") == K.SINGLE).groupBy("scope_key", "subject_id").agg(F.max("act").alias("last"))
    fresh = acts.where("not known").select(F.col("claim_id").alias("id"), "scope_key", "subject_id", "relation", "object_id", F.col("literal").alias("object_value"), F.lit("retracted").alias("state"), "origin_seq", F.lit(None).cast("long").alias("first_seen_at"), F.lit(None).cast("long").alias("last_seen_at"))
    every = p.claims.select(*schema.TABLES["claims"].names).unionByName(fresh).withColumnRenamed("id", "claim_id")
    every = every.join(acts.select("scope_key", "claim_id", "act"), ["scope_key", "claim_id"], "left").join(retracted, ["scope_key", "claim_id"], "left").join(slots, ["scope_key", "subject_id"], "left")
    single = F.col("relation") == K.SINGLE
    state = (
        F.when(F.col("retracted_at").isNotNull() & (F.col("act").isNull() | (F.col("retracted_at") > F.col("act.order_seq"))), "retracted")
        .when(F.col("act").isNotNull(), F.when(single & (F.col("last") > F.col("act")), "superseded").otherwise("active"))
        .when(single & F.col("last").isNotNull() & (F.col("state") == "active"), "superseded")
        .otherwise(F.col("state"))
    )
    # times: of touched claims only, from their live supports, else from the statement that they first stood in
    touched = acts.select("scope_key", "claim_id").union(retracted.select("scope_key", "claim_id")).distinct()
    seqs = history.select("scope_key", F.col("id").alias("event_id"), "seq").unionByName(steps.events.select("scope_key", F.col("id").alias("event_id"), "seq"))
    times = p.statements.select("scope_key", "event_id", "created_at").unionByName(steps.stated.select("scope_key", F.col("id").alias("event_id"), "created_at"))
    s = support.join(touched, ["scope_key", "claim_id"], "left_semi").join(times, ["scope_key", "event_id"]).join(seqs, ["scope_key", "event_id"])
    live = lambda f: f(F.when(F.col("live") == 1, F.col("created_at")))
    seen = s.groupBy("scope_key", "claim_id").agg(live(F.min).alias("first"), live(F.max).alias("last_at"), F.min(F.struct("seq", "draft_index", "created_at")).alias("anchor"))
    every = every.withColumn("state", state).join(seen, ["scope_key", "claim_id"], "left")
    claims = every.select(F.col("claim_id").alias("id"), "scope_key", "subject_id", "relation", "object_id", "object_value", "state", "origin_seq", F.when(F.col("anchor").isNull(), F.col("first_seen_at")).otherwise(F.coalesce("first", "anchor.created_at")).alias("first_seen_at"), F.when(F.col("anchor").isNull(), F.col("last_seen_at")).otherwise(F.coalesce("last_at", "anchor.created_at")).alias("last_seen_at"))

    # entities keep their kind; one without takes the first that the new events give
    kinds = projection.entity_rows(steps.mentioned, found).select("scope_key", "id", F.col("kind").alias("new_kind"))
    old = p.entities.select("scope_key", "id", F.col("kind").alias("old_kind"))
    entities = found.join(kinds, ["scope_key", "id"]).join(old, ["scope_key", "id"], "left").select("id", "scope_key", "name", "normal_name", F.coalesce("old_kind", "new_kind").alias("kind"), F.lit(None).cast("string").alias("merged_into"), "origin_seq")

    both = projection.surfaces(steps.mentioned, found).unionByName(p.surface_forms.select("scope_key", "surface_norm", "entity_id", "origin"))
    best = F.row_number().over(Window.partitionBy("scope_key", "surface_norm", "entity_id").orderBy(F.desc(projection._rank(F.col("origin"), K.ORIGIN_RANK))))
    surfaces = both.withColumn("n", best).where("n = 1").drop("n")
    return Projection(
        statements=p.statements.select(*schema.TABLES["statements"].names).unionByName(steps.stated.select(F.col("id").alias("event_id"), "scope_key", "state", "order_seq", "created_at", "provenance", "expires_at")),
        entities=entities,
        surface_forms=surfaces,
        claims=claims,
        claim_support=support,
        id_redirects=p.id_redirects.select(*schema.TABLES["id_redirects"].names).unionByName(projection.redirects(steps.mentioned, found, resolved)),
    )
