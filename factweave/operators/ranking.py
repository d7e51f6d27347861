"""Ranked claims: text, score and total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave import constants as K
from factweave.functions import identifiers as ids
from factweave.operators import validity

#: The total order of ranked claims.
def order() -> list[Column]:
    return [F.desc("score"), F.asc("depth"), F.desc("strongest_rank"), F.desc("support_count"), F.desc("last_seen_at"), F.asc("origin_seq"), ids.position_of(F.col("claim_id")).asc(), F.asc("claim_id")]


def brief(subject: Column, relation: Column, label: Column, shown: Column) -> Column:
    """Subject, predicate and object or literal as one line."""
    default = F.lit(None).cast("string")
    for k, v in K.PREDICATES.items():
        default = F.when(relation == k, v).otherwise(default)
    return F.concat_ws(" ", subject, F.coalesce(label, default), shown)


def scored(reached: DataFrame, claims: DataFrame, entities: DataFrame, now: int) -> DataFrame:
    """Reached claims (scope_key, claim_id, depth, ...) that are valid, with text, recency, contest and score."""
    name = entities.select("scope_key", F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    other = entities.select("scope_key", F.col("id").alias("object_id"), F.col("name").alias("object"))
    c = claims.join(name, ["scope_key", "subject_id"]).join(other, ["scope_key", "object_id"], "left")
    flag = validity.contested(claims).withColumn("contested", F.lit(1))
    c = reached.join(c, ["scope_key", "claim_id"]).join(flag, ["scope_key", "claim_id"], "left").withColumn("contested", F.coalesce("contested", F.lit(0)))
    c = c.withColumn("recent", F.col("last_seen_at").between(now - K.RECENT, now).cast("int"))
    weight = F.when(F.col("strongest_rank") == 3, 6).when(F.col("strongest_rank") == 2, 4).otherwise(1)
    score = -2 * F.col("depth") + weight + F.least(F.col("support_count"), F.lit(4)) + 2 * F.col("recent") - 3 * F.col("contested")
    return c.withColumn("score", score).withColumn("text", brief(F.col("subject"), F.col("relation"), F.col("relation_label"), F.coalesce("object", "object_value")))


def top(ranked: DataFrame, limit: int, by: list[str] | None = None) -> DataFrame:
    """The first `limit` of each group `by` (or of all), with their place, the total, and whether more are available."""
    by = by or ["scope_key"]
    totals = ranked.groupBy(*by).agg(F.count("*").alias("total"))
    w = Window.partitionBy(*by).orderBy(*order())
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).join(totals, by).withColumn("more_available", (F.col("total") > limit).cast("int"))
