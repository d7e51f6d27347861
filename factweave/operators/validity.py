"""What holds at a fixed time: valid supports, the claim aggregate, contested claims. `now` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factweave import constants as K
from factweave.functions import text
from factweave.operators import prescan
from factweave.operators.projection import Projection


def unexpired(now: int, column: str = "expires_at") -> Column:
    """The one lifetime predicate: an expiry at `now` is over."""
    return F.col(column).isNull() | (F.col(column) > now)


def live_statements(statements: DataFrame, now: int) -> DataFrame:
    return statements.where((F.col("state") == "live") & unexpired(now))


def valid_supports(p: Projection, now: int, scope: str | None = None) -> DataFrame:
    """Supports that count at `now`, with what the aggregate needs of their statements."""
    live = p.claim_support.where("live = 1")
    claims = p.claims.where("state = 'active'").select("scope_key", F.col("id").alias("claim_id"))
    s = live_statements(p.statements, now).select("scope_key", "event_id", "created_at", "provenance", "order_seq", F.col("expires_at").alias("statement_expires_at"))
    if scope is not None:
        live, claims, s = (x.where(F.col("scope_key") == scope) for x in (live, claims, s))
    return live.join(s, ["scope_key", "event_id"]).join(claims, ["scope_key", "claim_id"])


def labels(journal: DataFrame) -> DataFrame:
    """(scope_key, event_id, draft_index, label, seq) of drafts with a label that is not blank."""
    d = prescan.parsed(journal.where("kind = 'statement'")).select("scope_key", F.col("id").alias("event_id"), "seq", F.posexplode("b.parsed").alias("draft_index", "d"))
    return d.select("scope_key", "event_id", "draft_index", "seq", text.relation_label(F.col("d.relation_label")).alias("label"))


def claim_aggregate(p: Projection, journal: DataFrame, now: int, scope: str | None = None) -> DataFrame:
    """(scope_key, claim_id, support_count, strongest_rank, last_seen_at, relation_label, effective_expires_at): all validity comes from here."""
    v = valid_supports(p, now, scope).join(labels(journal), ["scope_key", "event_id", "draft_index"])
    rank = F.lit(None).cast("int")
    for k, r in K.PROVENANCE_RANK.items():
        rank = F.when(F.col("provenance") == k, r).otherwise(rank)
    label = F.max(F.when(F.col("label").isNotNull(), F.struct("order_seq", "seq", "draft_index", "label")))
    open_ended = F.count("*") > F.count("statement_expires_at")
    return v.groupBy("scope_key", "claim_id").agg(
        F.count("*").alias("support_count"), F.max(rank).alias("strongest_rank"), F.max("created_at").alias("last_seen_at"), label["label"].alias("relation_label"),
        F.when(~open_ended, F.max("statement_expires_at")).alias("effective_expires_at"),
    )


def valid_claims(p: Projection, aggregate: DataFrame) -> DataFrame:
    """Claims with their aggregate."""
    return p.claims.withColumnRenamed("id", "claim_id").drop("state", "last_seen_at").join(aggregate, ["scope_key", "claim_id"])


def contested(claims: DataFrame) -> DataFrame:
    """(scope_key, claim_id) of valid claims that a valid claim of the opposite relation meets: same subject and object, nulls alike."""
    c = claims.where(F.col("relation").isin(*K.OPPOSITE)).select("scope_key", "claim_id", "subject_id", "relation", "object_id", "object_value")
    other = c.select("scope_key", "subject_id", F.when(F.col("relation") == "uses", "rejects").otherwise("uses").alias("relation"), "object_id", "object_value").distinct()
    a, b = c.alias("a"), other.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("scope_key", "subject_id", "relation")] + [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("object_id", "object_value")]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return a.join(b, on, "left_semi").select("scope_key", "claim_id")
