"""Set-based projection of a journal: the six tables from joins, sums and windows.

It holds for scopes without an effective merge or alias and without an alias
that is another entity's name; the others go through the fold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave import constants as K
from factweave.functions import identifiers as ids, text
from factweave.operators import prescan
from factweave.operators.prescan import Refused
from factweave.scratch import compact


@dataclass(frozen=True)
class Projection:
    """The six tables, each with its scope."""

    statements: DataFrame
    entities: DataFrame
    surface_forms: DataFrame
    claims: DataFrame
    claim_support: DataFrame
    id_redirects: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(vars(self))


@dataclass(frozen=True)
class Prepared:
    """What both ways of projecting and the choice between them share: bodies parsed once, names normalised once, each step written."""

    events: DataFrame
    stated: DataFrame
    drafts: DataFrame
    mentioned: DataFrame

    def only(self, scopes: DataFrame, how: str) -> Prepared:
        """The part of some scopes (left_semi), or of the others (left_anti)."""
        return Prepared(**{k: t.join(scopes, "scope_key", how) for k, t in vars(self).items()})


def prepared(journal: DataFrame) -> Prepared:
    """The steps before projection. A journal that breaks a rule of events or statements is refused."""
    events = compact(prescan.parsed(journal), "events")
    stated = compact(prescan.statements(events), "statements")
    bad = prescan.event_violations(events).unionByName(prescan.supersedes_violations(events, stated)).take(1)
    if bad:
        raise Refused(bad[0]["problem"])
    drafts = compact(prescan.occurrences(stated), "drafts")
    return Prepared(events, stated, drafts, compact(mentions(drafts), "mentions"))


def _rank(column: Column, table: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def mentions(drafts: DataFrame) -> DataFrame:
    """Entity occurrences of drafts: (scope_key, ref, seq, position, name, normal_name, state, order_seq, draft_index, place, kind)."""
    own = F.array(
        F.struct(F.col("subject_ref").alias("ref"), F.col("position").alias("position"), F.col("d.subject").alias("name"), F.col("s_norm").alias("normal_name"), F.col("d.subject_kind").alias("kind"), F.col("d.subject_aliases").alias("aliases"), F.lit(0).alias("place")),
        F.struct(F.col("object_ref").alias("ref"), (F.col("position") + 1).alias("position"), F.col("d.object").alias("name"), F.col("o_norm").alias("normal_name"), F.col("d.object_kind").alias("kind"), F.col("d.object_aliases").alias("aliases"), F.lit(1).alias("place")),
    )
    m = drafts.select("scope_key", "seq", "order_seq", "state", "draft_index", F.explode(own).alias("m")).where("m.ref is not null")
    return m.select("scope_key", "seq", "order_seq", "state", "draft_index", "m.*").withColumn("kind", text.normalize_kind("kind"))


def entities_of(mentioned: DataFrame) -> DataFrame:
    """(scope_key, normal_name, id, name, origin_seq, own_state): the first occurrence of each name, dead statements included."""
    first = mentioned.groupBy("scope_key", "normal_name").agg(F.min(F.struct("seq", "position", "ref", "name", "state")).alias("f"))
    return first.select("scope_key", "normal_name", F.col("f.ref").alias("id"), F.col("f.name").alias("name"), F.col("f.seq").alias("origin_seq"), F.col("f.state").alias("own_state"))


def resolved_claims(drafts: DataFrame, entities: DataFrame) -> DataFrame:
    """Drafts with canonical subject_id, object_id, literal, and claim_id, the first occurrence of their identity."""
    e = entities.select("scope_key", "normal_name", "id")
    d = drafts.join(e.withColumnsRenamed({"normal_name": "s_norm", "id": "subject_id"}), ["scope_key", "s_norm"]).join(e.withColumnsRenamed({"normal_name": "o_norm", "id": "object_id"}), ["scope_key", "o_norm"], "left")
    identity = ["scope_key", "subject_id", F.col("d.relation").alias("relation"), F.coalesce("object_id", F.lit("")).alias("o"), F.coalesce("literal", F.lit("")).alias("l")]
    first = d.groupBy(*identity).agg(F.min(F.struct("seq", "draft_index", "claim_ref")).alias("f")).select("scope_key", "subject_id", "relation", "o", "l", F.col("f.claim_ref").alias("claim_id"), F.col("f.seq").alias("origin_seq"))
    keyed = d.withColumn("relation", F.col("d.relation")).withColumn("o", F.coalesce("object_id", F.lit(""))).withColumn("l", F.coalesce("literal", F.lit("")))
    return keyed.join(first, ["scope_key", "subject_id", "relation", "o", "l"]).drop("o", "l")


def retractions(journal: DataFrame, resolved: DataFrame) -> DataFrame:
    """(scope_key, claim_id, retracted_at): the last retraction of each claim; targets may be old ids."""
    r = prescan.parsed(journal.where("kind = 'retraction'")).where("b.target.claim_id is not null").select("scope_key", F.col("seq").alias("r_seq"), F.col("b.target.claim_id").alias("claim_ref"))
    return r.join(resolved.select("scope_key", "claim_ref", "claim_id"), ["scope_key", "claim_ref"]).groupBy("scope_key", "claim_id").agg(F.max("r_seq").alias("retracted_at"))


def supports(resolved: DataFrame, retracted: DataFrame) -> DataFrame:
    """Support of each claim by each event; live unless the statement is dead or a later claim retraction took it."""
    live = (F.col("state") == "live") & (F.col("order_seq") > F.coalesce("retracted_at", F.lit(0)))
    each = resolved.join(retracted, ["scope_key", "claim_id"], "left").withColumn("live", live.cast("int"))
    return each.groupBy("scope_key", "claim_id", "id").agg(F.min("draft_index").alias("draft_index"), F.max("live").alias("live"), F.first("expires_at").alias("expires_at"), F.first("created_at").alias("created_at"), F.first("order_seq").alias("order_seq"), F.first("seq").alias("seq")).withColumnRenamed("id", "event_id")


def claims_of(resolved: DataFrame, retracted: DataFrame) -> DataFrame:
    """Claims with their state: the order (order_seq, seq, draft) of the last activation decides against retractions and rivals."""
    live = F.col("state") == "live"
    order = F.struct("order_seq", "seq", "draft_index")
    c = resolved.groupBy("scope_key", "claim_id").agg(
        *(F.first(x).alias(x) for x in ("subject_id", "relation", "object_id", "literal", "origin_seq")), F.max(F.when(live, order)).alias("act"),
        F.min(F.struct("seq", "draft_index", "created_at")).alias("anchor"),
    ).join(retracted, ["scope_key", "claim_id"], "left")
    slot = Window.partitionBy("scope_key", "subject_id", F.col("relation") == K.SINGLE)
    last = F.when(F.col("relation") == K.SINGLE, F.max("act").over(slot))
    state = F.when(F.col("act").isNull() | (F.col("retracted_at") > F.col("act.order_seq")), "retracted").when((F.col("relation") == K.SINGLE) & (last > F.col("act")), "superseded").otherwise("active")
    return c.withColumn("claim_state", state)


def unusable(p: Prepared, refs: DataFrame | None = None) -> DataFrame:
    """(scope_key, seq, problem): names without content, and retractions of claims that aren't there or not yet. refs: (scope_key, claim_ref) of all claims, where the drafts are only some."""
    empty = p.drafts.where("s_norm is null or (d.object is not null and o_norm is null)").select("scope_key", "seq", F.lit("EMPTY_NAME").alias("problem"))
    r = p.events.where("kind = 'retraction' and b.target.claim_id is not null").select("scope_key", "seq", F.col("b.target.claim_id").alias("claim_ref"))
    # a draft whose name is empty has no resolved claim, but what it states is there to be retracted
    own = p.drafts.select("scope_key", "claim_ref")
    own = (own if refs is None else own.unionByName(refs.select("scope_key", "claim_ref"))).distinct().withColumn("known", F.lit(True))
    problem = F.when(ids.seq_of(F.col("claim_ref")) >= F.col("seq"), "CLAIM_RETRACTION_TARGET_NOT_PAST").when(F.col("known").isNull(), "CLAIM_RETRACTION_TARGET_NOT_FOUND")
    lost = r.join(own, ["scope_key", "claim_ref"], "left").select("scope_key", "seq", problem.alias("problem")).where("problem is not null")
    return empty.unionByName(lost)


def refusals(p: Prepared, resolved: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(scope_key, seq, problem) of what the model refuses when events are applied: what is unusable(), and a claim stated twice by one live statement."""
    twice = duplicate_identities(resolved.where("state = 'live'")).select("scope_key", "seq", F.lit("DUPLICATE_STATEMENT_CLAIM").alias("problem"))
    return unusable(p, refs).unionByName(twice)


def project(journal: DataFrame) -> Projection:
    """The projection of a journal whose scopes all fit the set-based way."""
    return project_prepared(prepared(journal))


def project_prepared(p: Prepared) -> Projection:
    """As project(). What the fold refuses is refused here too."""
    journal, stated, drafts, mentioned = p.events, p.stated, p.drafts, p.mentioned
    found = compact(entities_of(mentioned), "entities")  # each step feeds several others, so each is written
    resolved = compact(resolved_claims(drafts, found), "claims")
    if bad := refusals(p, resolved).take(1):
        raise Refused(bad[0]["problem"])
    retracted = compact(retractions(journal, resolved), "retractions")
    support = compact(supports(resolved, retracted), "supports")
    seen = support.where("live = 1").groupBy("scope_key", "claim_id").agg(F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    claims = claims_of(resolved, retracted).join(seen, ["scope_key", "claim_id"], "left")
    return Projection(
        statements=stated.select(F.col("id").alias("event_id"), "scope_key", "state", "order_seq", "created_at", "provenance", "expires_at"),
        entities=entity_rows(mentioned, found),
        surface_forms=surfaces(mentioned, found),
        claims=claims.select(F.col("claim_id").alias("id"), "scope_key", "subject_id", "relation", "object_id", F.col("literal").alias("object_value"), F.col("claim_state").alias("state"), "origin_seq", F.coalesce("first_seen", "anchor.created_at").alias("first_seen_at"), F.coalesce("last_seen", "anchor.created_at").alias("last_seen_at")),
        claim_support=support.select("scope_key", "claim_id", "event_id", "draft_index", "live", "expires_at"),
        id_redirects=redirects(mentioned, found, resolved),
    )


def entity_rows(mentioned: DataFrame, found: DataFrame) -> DataFrame:
    """Entities with their kind: the first that a live statement gives, by order, draft and place."""
    said = mentioned.where("state = 'live' and kind is not null").groupBy("scope_key", "normal_name").agg(F.min(F.struct("order_seq", "seq", "draft_index", "place", "kind")).alias("k"))
    return found.join(said, ["scope_key", "normal_name"], "left").select("id", "scope_key", "name", "normal_name", F.col("k.kind").alias("kind"), F.lit(None).cast("string").alias("merged_into"), "origin_seq")


def kind_conflicts(mentioned: DataFrame, found: DataFrame) -> DataFrame:
    """(scope_key, id, kinds): entities that live statements give several kinds, for maintenance."""
    said = mentioned.where("state = 'live' and kind is not null").groupBy("scope_key", "normal_name").agg(F.array_sort(F.collect_set("kind")).alias("kinds")).where(F.size("kinds") > 1)
    return said.join(found, ["scope_key", "normal_name"]).select("scope_key", "id", "kinds")


def surfaces(mentioned: DataFrame, found: DataFrame) -> DataFrame:
    """Names and aliases of live statements; the strongest origin of each (name, entity)."""
    live = mentioned.where("state = 'live'").join(found.select("scope_key", "normal_name", "id", "own_state"), ["scope_key", "normal_name"])
    names = live.select("scope_key", F.col("normal_name").alias("surface_norm"), F.col("id").alias("entity_id"), F.when(F.col("own_state") == "live", "name").otherwise("agent_supplied").alias("origin"))
    aliases = live.where("aliases is not null").select("scope_key", F.col("id").alias("entity_id"), F.explode("aliases").alias("a")).select("scope_key", text.normalize_name("a").alias("surface_norm"), "entity_id", F.lit("agent_supplied").alias("origin")).where("surface_norm is not null")
    both = names.select("scope_key", "surface_norm", "entity_id", "origin").unionByName(aliases)
    best = both.groupBy("scope_key", "surface_norm", "entity_id").agg(F.max(_rank(F.col("origin"), K.ORIGIN_RANK)).alias("r"))
    origin = F.element_at(F.array(*(F.lit(x) for x in sorted(K.ORIGIN_RANK, key=K.ORIGIN_RANK.get))), F.col("r"))
    return best.select("scope_key", "surface_norm", "entity_id", origin.alias("origin"))


def redirects(mentioned: DataFrame, found: DataFrame, resolved: DataFrame) -> DataFrame:
    """Later occurrences lead to the first ones."""
    e = mentioned.join(found.select("scope_key", "normal_name", "id"), ["scope_key", "normal_name"]).where("ref != id").select("scope_key", F.col("ref").alias("old_id"), F.col("id").alias("new_id"), F.lit("entity").alias("kind"))
    c = resolved.where("claim_ref != claim_id").select("scope_key", F.col("claim_ref").alias("old_id"), F.col("claim_id").alias("new_id"), F.lit("claim").alias("kind"))
    return e.unionByName(c).withColumn("reason", F.lit("deduplicated"))


def ordered_scopes(p: Prepared) -> DataFrame:
    """(scope_key) of scopes that only the reducer can project: with a merge or alias that stands, or an alias that is another entity's name."""
    decided = prescan.decisions(p.events).select("scope_key").distinct()
    mentioned = p.mentioned
    names = mentioned.select("scope_key", "normal_name").distinct()
    aliased = mentioned.where("state = 'live' and aliases is not null").select("scope_key", F.col("normal_name").alias("of"), F.explode("aliases").alias("a")).select("scope_key", "of", text.normalize_name("a").alias("normal_name")).where("normal_name != of")
    return decided.unionByName(aliased.join(names, ["scope_key", "normal_name"]).select("scope_key").distinct()).distinct()


def duplicate_identities(resolved: DataFrame) -> DataFrame:
    """(scope_key, id, seq, claim_id): a statement may state a claim once only; empty for a valid journal."""
    return resolved.groupBy("scope_key", "id", "seq", "claim_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
