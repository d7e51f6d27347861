"""Entries of a query: query terms, surface seeds, phrase search with bm25, and overviews."""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from factweave import constants as K
from factweave.functions import identifiers as ids, text
from factweave.operators import redirects, validity
from factweave.operators.projection import Projection


def query_terms(query: str, terms: list[str] | None = None) -> list[tuple[str, str]]:
    """(term, normal name) of a request, at most TERMS: given terms in their order, else the query and its runs of letters and digits, longest first.

    More than TERMS given terms, and empty or too long ones, are refused. Terms
    whose name is shorter than TERM_LEAST are left out.
    """
    query = text.trimmed(query)
    if not 1 <= len(query) <= K.QUERY_POINTS:
        raise ValueError("INVALID_QUERY")
    if terms is not None and (len(terms) > K.TERMS or not all(isinstance(t, str) and 1 <= len(t) <= K.TERM_POINTS for t in terms)):
        raise ValueError("INVALID_TERMS")
    named = lambda found: [(t, n) for t in map(text.trimmed, found) if (n := text.normal_name(t)) and len(n) >= K.TERM_LEAST]
    if terms is not None:
        return named(terms)
    runs = ["".join(g) for g in _runs(query)]
    found = named([query, *(runs if runs != [query] else [])])
    order = sorted(range(len(found)), key=lambda i: (-len(found[i][1]), i))
    return [found[i] for i in order][: K.TERMS]


def _runs(query: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for c in query:
        if unicodedata.category(c)[0] in "LN":
            out[-1].append(c)
        elif out[-1]:
            out.append([])
    return [g for g in out if g]


def values(spark: SparkSession, terms: list[tuple[str, str]]) -> DataFrame:
    """(term_order, term, surface_norm): an inline source that keeps the order."""
    return spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(terms)], "term_order int, term string, surface_norm string")


def surface_seeds(p: Projection, requested: DataFrame, limit: int = K.SEEDS) -> DataFrame:
    """(scope_key, entity_id, matched_term, surface_norm, seed_order, more): entities whose names or aliases are requested.

    Redirected entities lead to where they have gone. Within a term the order is
    that of the ids as text; an entity counts once, at its first term.
    """
    if requested.limit(K.TERMS + 1).count() <= K.TERMS:
        requested = F.broadcast(requested)
    hits = p.surface_forms.join(requested, "surface_norm")
    hits = redirects.resolved(hits, p.id_redirects.where("kind = 'entity'"), "entity_id")
    first = hits.groupBy("scope_key", "entity_id").agg(F.min(F.struct("term_order", "surface_norm", "term")).alias("f"))
    order = Window.partitionBy("scope_key").orderBy("f.term_order", "entity_id")
    # the filter is on the row number itself, so each task keeps only the first rows before they are dealt out
    ranked = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit + 1).withColumn("seed_order", F.col("n") - 1)
    more = F.max((F.col("seed_order") >= limit).cast("int")).over(Window.partitionBy("scope_key"))
    return ranked.withColumn("more", more).where(F.col("seed_order") < limit).select("scope_key", "entity_id", F.col("f.term").alias("matched_term"), F.col("f.surface_norm").alias("surface_norm"), "seed_order", "more")


_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f]")


def phrases(terms: list[str]) -> list[str]:
    """Phrases for a text search: without controls, trimmed, PHRASE_LEAST code points at least, PHRASES at most."""
    cleaned = [text.trimmed(_CONTROL.sub("", t)) for t in terms]
    return [t for t in cleaned if len(t) >= K.PHRASE_LEAST][: K.PHRASES]


def postings(texts: DataFrame) -> DataFrame:
    """(trigram, scope_key, seq) of texts (scope_key, seq, raw_text): each text once under each run of three of its folded characters. Rows never change, so a write only adds its own."""
    folded = F.regexp_replace(text.folded("raw_text"), "\x00", "")
    own = texts.select("scope_key", "seq", folded.alias("t")).where(F.length("t") >= K.PHRASE_LEAST)
    # characters first: a substring would count from the beginning each time
    own = own.select("scope_key", "seq", F.split("t", "").alias("c"), F.length("t").alias("n"))
    grams = F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.concat(F.get("c", i), F.get("c", i + 1), F.get("c", i + 2)))
    return own.select(F.explode(F.array_distinct(grams)).alias("trigram"), "scope_key", "seq")


def measured(texts: DataFrame) -> DataFrame:
    """(scope_key, n, length) of texts: what bm25 needs of all rows, added up by scope."""
    return texts.groupBy("scope_key").agg(F.count("*").alias("n"), F.sum(F.greatest(F.length("raw_text") - 2, F.lit(0))).alias("length"))


def posted(index: DataFrame, wanted: list[str]) -> DataFrame:
    """(scope_key, seq) of the rows of postings that have all trigrams of one of the phrases: few more than match."""
    grams = {p: sorted({p[i : i + 3] for i in range(len(p) - 2)}) for p in map(text.fold, wanted)}
    asked = [(g, k, len(own)) for k, own in enumerate(grams.values()) for g in own]
    found = index.join(F.broadcast(index.sparkSession.createDataFrame(asked, "trigram string, phrase int, of int")), "trigram")  # the request's phrases: at most PHRASES times their length
    return found.groupBy("scope_key", "seq", "phrase", "of").agg(F.count("*").alias("n")).where("n = of").select("scope_key", "seq").distinct()


def bm25(texts: DataFrame, wanted: list[str], totals: DataFrame | None = None) -> DataFrame:
    """texts (..., raw_text) that contain a phrase, with score (less is better) and the first phrase that matches.

    Statistics are over all rows given, whatever their scope or state; with totals
    (measured()) they are over the rows that it counts, and texts need only be
    those that posted() finds. Terms are trigrams, so a row's length is its code
    points less two; matches overlap and ignore case. One pass counts, one scores;
    phrases are a short list.
    """
    wanted = [text.fold(p) for p in wanted]
    rows = texts.withColumn("folded", text.folded("raw_text")).withColumn("length", F.greatest(F.length("raw_text") - 2, F.lit(0)))
    hit = [F.sum(F.col("folded").contains(p).cast("long")).alias(f"n{i}") for i, p in enumerate(wanted)]
    if totals is None:
        stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *hit).first().asDict()
    else:
        stats = totals.agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("mean")).first().asDict() | (rows.agg(*hit).first().asDict() if hit else {})
    if not wanted or not stats["n"]:
        return rows.where(F.lit(False)).withColumn("score", F.lit(0.0)).withColumn("phrase", F.lit(0)).drop("folded", "length")
    score: Column = F.lit(0.0)
    first = F.lit(None).cast("int")
    for i in reversed(range(len(wanted))):
        first = F.when(F.col("folded").contains(wanted[i]), i).otherwise(first)
    for i, p in enumerate(wanted):
        n = stats[f"n{i}"] or 0
        odds = (stats["n"] - n + 0.5) / (n + 0.5)
        idf = max(math.log(odds), 0.0) or 1e-6
        f = F.when(F.col("folded").contains(p), text.occurrences(F.col("folded"), p)).otherwise(0)
        score = score - F.when(f > 0, idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("length") / stats["mean"]))).otherwise(0.0)
    return rows.withColumn("phrase", first).where("phrase is not null").withColumn("score", score).drop("folded", "length")


def search(texts: DataFrame, wanted: list[str], limit: int = K.FTS_ROWS) -> DataFrame:
    """The best `limit` rows of a phrase search, better scores and then newer rows first."""
    return bm25(texts, wanted).orderBy(F.round("score", 9), F.desc("seq")).limit(limit)


def raw_only(raw: DataFrame, stated: DataFrame) -> DataFrame:
    """Raw statements (scope_key, raw_text, ...) without drafts, whose text no statement of a valid claim has: a claim's text never comes back as raw."""
    return raw.join(stated.select("scope_key", "raw_text").distinct(), ["scope_key", "raw_text"], "left_anti")


def incidents(claims: DataFrame) -> DataFrame:
    """(scope_key, from_id, claim_id, to_id or null): claims from both their ends; a loop counts once."""
    out = claims.select("scope_key", F.col("subject_id").alias("from_id"), "claim_id", F.col("object_id").alias("to_id"))
    back = claims.where("object_id is not null and object_id != subject_id").select("scope_key", F.col("object_id").alias("from_id"), "claim_id", F.col("subject_id").alias("to_id"))
    return out.unionByName(back)


def overview_entities(claims: DataFrame, entities: DataFrame, limit: int = K.OVERVIEW_SEEDS) -> DataFrame:
    """The entities of most valid claims in each scope: (scope_key, entity_id, name, incident_claims, last_seen_at, place)."""
    both = incidents(claims).join(claims.select("scope_key", "claim_id", "last_seen_at"), ["scope_key", "claim_id"])
    agg = both.groupBy("scope_key", F.col("from_id").alias("entity_id")).agg(F.countDistinct("claim_id").alias("incident_claims"), F.max("last_seen_at").alias("last_seen_at"))
    order = Window.partitionBy("scope_key").orderBy(F.desc("incident_claims"), F.desc("last_seen_at"), ids.numeric(F.col("entity_id")))
    top = agg.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return top.join(entities.select("scope_key", F.col("id").alias("entity_id"), "name"), ["scope_key", "entity_id"])


def overview_raw(raw: DataFrame, now: int, limit: int = K.LIMIT) -> DataFrame:
    """The newest raw statements of each scope that live at `now`."""
    order = Window.partitionBy("scope_key").orderBy(F.desc("created_at"), F.desc("seq"))
    return raw.where(validity.unexpired(now)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def phrase_seeds(hits: DataFrame, p: Projection, valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, pins) of phrase hits (scope_key, event_id, place, phrase): ends of the valid claims that they support, subjects before objects, with the phrase that led there; and the claims, at depth 0 and the place of their subject."""
    s = p.claim_support.where("live = 1").join(hits.select("scope_key", "event_id", "place"), ["scope_key", "event_id"]).join(valid.select("scope_key", "claim_id", "subject_id", "object_id", "origin_seq"), ["scope_key", "claim_id"])
    ends = s.select("scope_key", "place", "draft_index", "claim_id", "origin_seq", F.posexplode(F.array("subject_id", "object_id")).alias("end", "entity_id")).where("entity_id is not null")
    first = ends.groupBy("scope_key", "entity_id").agg(F.min(F.struct("place", "draft_index", "origin_seq", "end")).alias("f"))
    order = Window.partitionBy("scope_key").orderBy("f", "entity_id")
    shown = hits.select("scope_key", "place", "phrase")
    every = first.withColumn("seed_order", F.row_number().over(order) - 1).withColumn("place", F.col("f.place")).join(shown, ["scope_key", "place"])  # ends of the claims of at most FTS_ROWS statements
    seeds = every.where(F.col("seed_order") < K.SEEDS).select("scope_key", "entity_id", "seed_order", "phrase")
    pins = s.groupBy("scope_key", "claim_id").agg(F.first("subject_id").alias("anchor_id")).withColumn("depth", F.lit(0))
    return seeds, pins.join(every.select("scope_key", F.col("entity_id").alias("anchor_id"), "seed_order"), ["scope_key", "anchor_id"])
