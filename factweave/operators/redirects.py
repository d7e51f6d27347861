"""Redirects: path compression by pointer doubling, and what is wrong with a set of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factweave import constants as K
from factweave.scratch import materialize

#: Doublings that walk at least REDIRECT_HOPS hops.
ROUNDS = (K.REDIRECT_HOPS - 1).bit_length() + 1


def compressed(redirects: DataFrame) -> DataFrame:
    """Redirects (scope_key, old_id, new_id, kind, reason) with new_id at the end of each path, and the hops to it; paths that do not end are left out.

    Each round joins the pointers with themselves and is written, so a path of
    32 hops takes 6 rounds.
    """
    start = redirects.select("scope_key", "old_id", "new_id", "kind", "reason", F.lit(1).alias("hops"))
    moving = materialize(start, "redirects")
    for _ in range(ROUNDS):
        far = moving.select("scope_key", F.col("old_id").alias("new_id"), F.col("new_id").alias("far"), F.col("hops").alias("more"))
        step = moving.join(far, ["scope_key", "new_id"], "left").select("scope_key", "old_id", F.coalesce("far", "new_id").alias("new_id"), "kind", "reason", (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("far").isNotNull().alias("moved"))
        step = materialize(step, "redirects")
        moving = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    ends = redirects.select("scope_key", F.col("old_id").alias("new_id"))
    return moving.join(ends, ["scope_key", "new_id"], "left_anti").where(F.col("hops") <= K.REDIRECT_HOPS).select("scope_key", "old_id", "new_id", "kind", "reason", "hops")


def violations(redirects: DataFrame, anchors: DataFrame) -> DataFrame:
    """(scope_key, old_id, problem): loops, several ways out, unknown ids, kinds or scopes that differ, cycles and paths over 32 hops. anchors: (scope_key, id, kind)."""
    twice = redirects.groupBy("scope_key", "old_id").agg(F.count("*").alias("ways")).where("ways > 1").select("scope_key", "old_id", F.lit("SEVERAL_REDIRECTS").alias("problem"))
    known = anchors.select(F.col("scope_key").alias("own_scope"), F.col("id").alias("own_id"), F.col("kind").alias("own_kind"))
    old = redirects.join(known, F.col("old_id") == F.col("own_id"), "left").select(redirects["*"], F.col("own_scope").alias("o_scope"), F.col("own_kind").alias("o_kind"))
    both = old.join(known, F.col("new_id") == F.col("own_id"), "left")
    problem = F.when(F.col("old_id") == F.col("new_id"), "SELF_REDIRECT").when(F.col("o_scope").isNull() | F.col("own_scope").isNull(), "DANGLING_REDIRECT").when((F.col("o_kind") != F.col("kind")) | (F.col("own_kind") != F.col("kind")), "KIND_MISMATCH").when((F.col("o_scope") != F.col("scope_key")) | (F.col("own_scope") != F.col("scope_key")), "SCOPE_MISMATCH")
    single = both.select("scope_key", "old_id", problem.alias("problem")).where("problem is not null")
    endless = redirects.where("old_id != new_id").join(compressed(redirects).select("scope_key", "old_id"), ["scope_key", "old_id"], "left_anti").select("scope_key", "old_id", F.lit("CYCLE_OR_TOO_LONG").alias("problem"))
    return single.unionByName(twice).unionByName(endless).distinct()


def resolved(refs: DataFrame, redirects: DataFrame, column: str) -> DataFrame:
    """refs with a column of ids led to where they are now; redirects are compressed, so one join does it."""
    to = redirects.select("scope_key", F.col("old_id").alias(column), F.col("new_id").alias("__to"))
    return refs.join(to, ["scope_key", column], "left").withColumn(column, F.coalesce("__to", column)).drop("__to")
