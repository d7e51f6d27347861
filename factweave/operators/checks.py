"""Invariants, canonical digests, identity dry runs and rollout metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from factweave import constants as K, schema
from factweave.operators.projection import Projection


def violations(p: Projection) -> DataFrame:
    """(problem, n): how often each invariant is broken; all zero for a valid projection."""
    e, c, s, st = p.entities, p.claims, p.claim_support, p.statements
    ids = e.select("scope_key", F.col("id").alias("subject_id"))
    live = s.where("live = 1").select("scope_key", F.col("claim_id").alias("id")).distinct()
    statement = st.select("event_id", F.col("scope_key").alias("own_scope"), F.col("expires_at").alias("own_expiry"))
    support = s.join(statement, "event_id", "left")
    target = e.select("scope_key", F.col("id").alias("new_id")).unionByName(c.select("scope_key", F.col("id").alias("new_id")))
    checks = {
        "claim_subject_missing": c.join(ids, ["scope_key", "subject_id"], "left_anti"),
        "claim_object_missing": c.where("object_id is not null").join(ids.withColumnRenamed("subject_id", "object_id"), ["scope_key", "object_id"], "left_anti"),
        "claim_object_xor_literal": c.where("(object_id is null) = (object_value is null)"),
        "active_claim_without_live_support": c.where("state = 'active'").join(live, ["scope_key", "id"], "left_anti"),
        "support_without_claim": s.join(c.select("scope_key", F.col("id").alias("claim_id")), ["scope_key", "claim_id"], "left_anti"),
        "support_without_statement": support.where("own_scope is null"),
        "support_scope_mismatch": support.where("own_scope != scope_key"),
        "support_expiry_mismatch": support.where("own_scope is not null and not (expires_at <=> own_expiry)"),
        "redirect_target_missing": p.id_redirects.join(target, ["scope_key", "new_id"], "left_anti"),
        "surface_without_entity": p.surface_forms.join(ids.withColumnRenamed("subject_id", "entity_id"), ["scope_key", "entity_id"], "left_anti"),
        "several_active_describes": c.where("state = 'active' and relation = 'describes'").groupBy("scope_key", "subject_id").agg(F.count("*").alias("n")).where("n > 1"),
        "duplicate_active_identity": c.where("state = 'active'").groupBy("scope_key", "subject_id", "relation", "object_id", "object_value").agg(F.count("*").alias("n")).where("n > 1"),
        "redirect_unlike_merge": e.where("merged_into is not null").join(p.id_redirects.select("scope_key", F.col("old_id").alias("id"), F.col("new_id").alias("merged_into")), ["scope_key", "id", "merged_into"], "left_anti"),
        "duplicate_entity_name": e.where("merged_into is null").groupBy("scope_key", "normal_name").agg(F.count("*").alias("n")).where("n > 1"),
    }
    return reduce(DataFrame.unionByName, (d.agg(F.count("*").alias("n")).select(F.lit(k).alias("problem"), "n") for k, d in checks.items()))


def row_counts(p: Projection) -> DataFrame:
    """(scope_key, name, n): the rows of each table by scope."""
    return reduce(DataFrame.unionByName, (t.groupBy("scope_key").agg(F.count("*").alias("n")).select("scope_key", F.lit(k).alias("name"), "n") for k, t in p.tables().items()))


def expiry_mismatches(statements: DataFrame, support: DataFrame, ttl: DataFrame) -> DataFrame:
    """One row of three counters: expiry against lifetime (event_id, ttl), support against statement, and scopes."""
    seconds = F.lit(None).cast("long")
    for k, v in K.TTL.items():
        seconds = F.when(F.col("ttl") == k, F.lit(v).cast("long")).otherwise(seconds)
    a = statements.join(ttl, "event_id").where(~F.col("expires_at").eqNullSafe(F.col("created_at") + seconds)).agg(F.count("*").alias("statement_expiry"))
    own = statements.select("event_id", F.col("scope_key").alias("own_scope"), F.col("expires_at").alias("own_expiry"))
    b = support.join(own, "event_id").agg(F.count(F.when(~F.col("expires_at").eqNullSafe(F.col("own_expiry")), 1)).alias("support_expiry"), F.count(F.when(F.col("scope_key") != F.col("own_scope"), 1)).alias("scope_mismatch"))
    return b.withColumn("statement_expiry", a.scalar())


def canonical_digest(p: Projection) -> DataFrame:
    """(scope_key, table, n, digest): each row is encoded with types and lengths and hashed; a table's digest is that of the sums of its rows' hashes, in five parts of 48 bits.

    Sums don't depend on an order, so no task sees the rows of a scope together. They
    tell tables apart that differ by accident, not ones made to collide.
    """
    out = []
    for name, df in p.tables().items():
        cells = [F.when(F.col(f.name).isNull(), F.lit("n")).otherwise(F.concat(F.lit(f.dataType.typeName()[0]), F.length(F.col(f.name).cast("string")).cast("string"), F.lit(":"), F.col(f.name).cast("string"))) for f in schema.TABLES[name]]
        row = F.sha2(F.concat_ws("|", F.lit(name), *cells), 256)
        part = lambda a: F.sum(F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(38,0)"))  # noqa: B023, E731
        sums = df.groupBy("scope_key").agg(F.count("*").alias("n"), *(part(1 + 12 * i).alias(f"p{i}") for i in range(5)))
        out.append(sums.select("scope_key", F.lit(name).alias("table"), "n", F.sha2(F.concat_ws(":", *(F.col(f"p{i}").cast("string") for i in range(5))), 256).alias("digest")))
    return reduce(DataFrame.unionByName, out)


def identity_dry_run(entities: DataFrame, rule) -> DataFrame:
    """(scope_key, id, groups, blocked, new_id): what another identity rule would do to entities. A group that splits blocks it; groups that meet would redirect to the first."""
    e = entities.where("merged_into is null").withColumn("new_name", rule(F.col("name")))
    split = e.groupBy("scope_key", "normal_name").agg(F.countDistinct("new_name").alias("groups"))
    keep = e.groupBy("scope_key", "new_name").agg(F.min(F.struct("origin_seq", "id")).alias("k"))
    found = e.join(split, ["scope_key", "normal_name"]).join(keep, ["scope_key", "new_name"])
    return found.select("scope_key", "id", "groups", (F.col("groups") > 1).cast("int").alias("blocked"), F.col("k.id").alias("new_id"))


def top_labels(claims: DataFrame, limit: int = 10) -> DataFrame:
    """(scope_key, label, n, place): the labels that most valid claims (scope_key, relation, relation_label) have; of equals the lesser first."""
    found = claims.where((F.col("relation") == K.LABELLED) & F.col("relation_label").isNotNull()).groupBy("scope_key", F.col("relation_label").alias("label")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("scope_key").orderBy(F.desc("n"), "label")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def rollout_metrics(claims: DataFrame, aggregate: DataFrame, contested: DataFrame) -> DataFrame:
    """(scope_key, claims, active, retracted, superseded, relates_share, contested, mean_support, p95_support, p99_support)."""
    state = lambda s: F.sum((F.col("state") == s).cast("long")).alias(s)
    by = claims.groupBy("scope_key").agg(F.count("*").alias("claims"), state("active"), state("retracted"), state("superseded"), F.avg((F.col("relation") == K.LABELLED).cast("double")).alias("relates_share"))
    support = aggregate.groupBy("scope_key").agg(F.avg("support_count").alias("mean_support"), F.percentile("support_count", 0.95).alias("p95_support"), F.percentile("support_count", 0.99).alias("p99_support"))
    fights = contested.groupBy("scope_key").agg(F.count("*").alias("contested"))
    return by.join(support, "scope_key", "left").join(fights, "scope_key", "left").withColumn("contested", F.coalesce("contested", F.lit(0)))
