"""Bounded breadth-first search over valid claims, level by level, for many requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave import constants as K
from factweave.functions import identifiers as ids, text
from factweave.operators import lookup
from factweave.scratch import materialize


def ranked_incidents(claims: DataFrame, fanout: int = K.FANOUT) -> tuple[DataFrame, DataFrame]:
    """(links, incidents) of each entity, the best `fanout` of each with their rank: links lead to entities, incidents include literals.

    `more` says that an entity has others. The rank is made once for all
    entities and requests.
    """
    facts = claims.select("scope_key", "claim_id", "support_count", "strongest_rank", "last_seen_at", "origin_seq")
    both = lookup.incidents(claims).join(facts, ["scope_key", "claim_id"])
    order = Window.partitionBy("scope_key", "from_id").orderBy(F.desc("support_count"), F.desc("strongest_rank"), F.desc("last_seen_at"), F.asc("origin_seq"), ids.position_of(F.col("claim_id")), F.asc("claim_id"))

    def best(rows: DataFrame) -> DataFrame:
        top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= fanout + 1)
        more = F.max((F.col("rank") > fanout).cast("int")).over(Window.partitionBy("scope_key", "from_id"))
        return top.withColumn("more", more).where(F.col("rank") <= fanout).select("scope_key", "from_id", "claim_id", "to_id", "rank", "more")

    return best(both.where("to_id is not null")), best(both)


#: What marks a phrase in a path.
PHRASE = " (FTS)"


def label(entry: str, display: Column, name: Column) -> Column:
    """What a path begins with before its first name, or null: a requested name that isn't the entity's own, or the phrase that led to it."""
    if entry == "fts":
        return text.shown(display, PHRASE)
    return F.when(display != name, text.shown(display)) if entry == "surface" else F.lit(None).cast("string")


def traverse(seeds: DataFrame, claims: DataFrame, entities: DataFrame, depth: int = K.DEPTH, fanout: int = K.FANOUT, entry: str = "surface") -> tuple[DataFrame, DataFrame]:
    """(visited, reached) from seeds (request_id, scope_key, entity_id, seed_order, display).

    The first discovery of an entity wins: frontier order, then rank of the link.
    Claims are met at each level, the last one too; links are followed below it.
    A claim keeps its least (depth, seed, discovery, rank), with the path of the
    entity where it was met, to which its other end is added unless the claim is
    a loop or led here. Hops count the steps between entities.
    """
    links, met = ranked_incidents(claims, fanout)
    links, met = materialize(links, "links"), materialize(met, "incidents")
    name = entities.select("scope_key", F.col("id").alias("entity_id"), "name")
    first = seeds.join(name, ["scope_key", "entity_id"])
    labels = first.select("request_id", "seed_order", label(entry, F.col("display"), F.col("name")).alias("label"))
    order = Window.partitionBy("request_id").orderBy("seed_order", "entity_id")
    frontier = first.select("request_id", "scope_key", "entity_id", "seed_order", F.row_number().over(order).cast("long").alias("discovery"), F.array("name").alias("path"), F.lit(None).cast("string").alias("via"), F.lit(0).alias("level"))
    frontier = materialize(frontier, "frontier")
    visited = frontier
    for level in range(depth):
        step = frontier.join(links.withColumnRenamed("from_id", "entity_id"), ["scope_key", "entity_id"]).select("request_id", "scope_key", F.col("to_id").alias("entity_id"), "seed_order", "discovery", "rank", "path", F.col("claim_id").alias("via"))
        step = step.join(visited.select("request_id", "entity_id"), ["request_id", "entity_id"], "left_anti")
        won = step.groupBy("request_id", "scope_key", "entity_id").agg(F.min(F.struct("discovery", "rank", "via", "seed_order", "path")).alias("w"))
        at = Window.partitionBy("request_id").orderBy("w.discovery", "w.rank")
        base = visited.groupBy("request_id").agg(F.max("discovery").alias("base"))
        found = won.join(base, "request_id").join(name, ["scope_key", "entity_id"])
        frontier = found.select("request_id", "scope_key", "entity_id", "w.seed_order", (F.col("base") + F.row_number().over(at)).alias("discovery"), F.concat("w.path", F.array("name")).alias("path"), F.col("w.via").alias("via"), F.lit(level + 1).alias("level"))
        frontier = materialize(frontier, "frontier")
        visited = visited.unionByName(frontier)
    all_ = visited.join(met.withColumnRenamed("from_id", "entity_id"), ["scope_key", "entity_id"])
    best = all_.groupBy("request_id", "scope_key", "claim_id").agg(F.min(F.struct("level", "seed_order", "discovery", "rank", "entity_id", "to_id", "via", "path")).alias("b"))
    other = name.select("scope_key", F.col("entity_id").alias("to_id"), F.col("name").alias("to_name"))
    best = best.select("request_id", "scope_key", "claim_id", F.col("b.level").alias("depth"), "b.seed_order", "b.discovery", F.col("b.entity_id").alias("anchor_id"), "b.to_id", "b.via", "b.path").join(other, ["scope_key", "to_id"], "left")
    adds = F.col("to_name").isNotNull() & (F.col("to_id") != F.col("anchor_id")) & ~F.col("via").eqNullSafe(F.col("claim_id"))
    full = F.when(adds, F.concat("path", F.array("to_name"))).otherwise(F.col("path"))
    best = best.join(labels, ["request_id", "seed_order"], "left")
    reached = best.select("request_id", "scope_key", "claim_id", "depth", "seed_order", "anchor_id", F.concat_ws(" → ", "label", full).alias("path"), (F.size(full) - 1).alias("hops"))
    return visited.select("request_id", "scope_key", "entity_id", "level", "seed_order", "discovery", "via"), reached
