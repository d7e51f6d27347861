"""The answer to a query: entry, traversal, ranking, raw texts in the places left, notes and details."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from factweave import constants as K
from factweave.functions import text
from factweave.operators import lookup, prescan, ranking, traversal, validity
from factweave.operators.projection import Projection


@dataclass(frozen=True)
class Request:
    scope: str
    query: str | None = None
    terms: list[str] | None = None
    depth: int = K.DEPTH
    limit: int = K.LIMIT
    detail: str = "brief"

    def __post_init__(self) -> None:
        if self.depth not in K.DEPTHS or not K.LIMITS[0] <= self.limit <= K.LIMITS[1] or self.detail not in ("brief", "full") or (self.query is not None and not self.query.strip()):
            raise ValueError("INVALID_REQUEST")


@dataclass
class Answer:
    """claims and raw are bounded by the request's limit."""

    entry: str
    claims: list[dict] = field(default_factory=list)
    raw: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def in_scope(p: Projection, scope: str) -> Projection:
    return Projection(**{k: t.where(F.col("scope_key") == scope) for k, t in p.tables().items()})


def _seeds(seeds: DataFrame, shown: str) -> DataFrame:
    return seeds.select(F.lit(0).alias("request_id"), "scope_key", "entity_id", "seed_order", F.expr(shown).alias("display"))


def answer(p: Projection, journal: DataFrame, request: Request, now: int, index: tuple[DataFrame, DataFrame] | None = None) -> Answer:
    """Names first; if none leads to a valid claim, phrases; without a query, an overview. All of it at one time and one version.

    index: lookup.postings() and lookup.measured() of the journal's statements, where they are stored.
    """
    spark = journal.sparkSession
    mine, p = journal.where(F.col("scope_key") == request.scope), in_scope(p, request.scope)
    if bad := prescan.body_violations(mine).take(1):  # what can't be read is not answered from
        raise prescan.Refused(bad[0]["problem"])
    held: list[DataFrame] = []
    valid = validity.valid_claims(p, validity.claim_aggregate(p, mine, now)).cache()
    stated = prescan.statements(mine).cache()
    raws = lookup.raw_only(validity.live_statements(stated, now).where(F.size("parsed") == 0), _valid_texts(stated, p, valid))
    answer, pins, seeds, texts = Answer("none"), None, None, None
    try:
        if request.query is None:
            answer.entry = "overview"
            top = lookup.overview_entities(valid, p.entities, min(request.limit, K.OVERVIEW_SEEDS) + 1)
            if top.count() > min(request.limit, K.OVERVIEW_SEEDS):
                answer.notes.append("more_entities_available")
            seeds = _seeds(top.where(F.col("place") <= min(request.limit, K.OVERVIEW_SEEDS)).withColumn("seed_order", F.col("place") - 1), "name")
            depth, texts = 0, lookup.overview_raw(raws, now, request.limit + 1)
        else:
            depth = request.depth
            terms = lookup.query_terms(request.query, request.terms)
            if terms:
                found = lookup.surface_seeds(p, lookup.values(spark, terms))
                meets = found.join(lookup.incidents(valid).select("scope_key", F.col("from_id").alias("entity_id")), ["scope_key", "entity_id"], "left_semi")
                if not meets.isEmpty():
                    answer.entry, seeds = "surface", _seeds(found, "matched_term")
                    if found.where("more = 1").count():
                        answer.notes.append("more_seeds_available")
            if seeds is None:
                wanted = lookup.phrases([t for t, _ in terms])
                all_ = prescan.parsed(journal.where("kind = 'statement'")).select("seq", F.col("id").alias("event_id"), "scope_key", F.col("b.raw_text").alias("raw_text"))
                if index is not None:
                    all_ = all_.join(lookup.posted(index[0], wanted), ["scope_key", "seq"], "left_semi")
                hits = lookup.bm25(all_, wanted, index and index[1]).where(F.col("scope_key") == request.scope).join(validity.live_statements(p.statements, now).select("event_id"), "event_id", "left_semi")
                order = Window.partitionBy("scope_key").orderBy(F.round("score", 9), F.desc("seq"))
                hits = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= K.FTS_ROWS + 1).cache()
                held.append(hits)
                if hits.count() > K.FTS_ROWS:
                    answer.notes.append("more_matches_available")
                hits = hits.where(F.col("place") <= K.FTS_ROWS)
                if not wanted:
                    answer.notes.append("phrase_search_skipped")
                elif not hits.isEmpty():
                    answer.entry = "fts"
                    found, pins = lookup.phrase_seeds(hits, p, valid)
                    shown = F.element_at(F.array(*map(F.lit, wanted)), F.col("phrase") + 1)
                    seeds = _seeds(found.withColumn("shown", shown), "shown")
                    texts = hits.join(raws.select(F.col("id").alias("event_id")), "event_id", "left_semi")
        if seeds is not None:
            _, reached = traversal.traverse(seeds, valid, p.entities, depth, entry=answer.entry)
            if pins is not None:
                extra = pins.join(reached.select("claim_id"), "claim_id", "left_anti")
                reached = reached.select("scope_key", "claim_id", "depth", "seed_order", "anchor_id", "path", "hops").unionByName(extra.select("scope_key", "claim_id", "depth", "seed_order", "anchor_id", F.lit(None).cast("string").alias("path"), F.lit(0).alias("hops")))
            ranked = ranking.top(ranking.scored(reached, valid, p.entities, now), request.limit)
            answer.claims = [r.asDict() for r in ranked.select("claim_id", "text", "score", "depth", "path", "hops", "contested", "support_count", text.iso_time(F.col("last_seen_at")).alias("last_seen"), "place", "more_available").orderBy("place").collect()]
            if any(c["more_available"] for c in answer.claims):
                answer.notes.append("more_claims_available")
        left = request.limit - len(answer.claims)
        if texts is not None and left > 0:
            rows = texts.orderBy("place").limit(left + 1).select("raw_text", "place").collect()
            answer.raw = [r.asDict() for r in rows[:left]]
            if len(rows) > left:
                answer.notes.append("more_texts_available")
        if request.detail == "full" and answer.claims:
            for c, rows in details(p, stated, [c["claim_id"] for c in answer.claims], now).items():
                next(x for x in answer.claims if x["claim_id"] == c)["statements"] = rows
    finally:
        valid.unpersist()
        stated.unpersist()
        for df in held:
            df.unpersist()
    return answer


def _valid_texts(stated: DataFrame, p: Projection, valid: DataFrame) -> DataFrame:
    """Texts of statements that support a valid claim."""
    s = p.claim_support.where("live = 1").join(valid.select("scope_key", "claim_id"), ["scope_key", "claim_id"], "left_semi").select("scope_key", F.col("event_id").alias("id"))
    return stated.join(s, ["scope_key", "id"], "left_semi").select("scope_key", "raw_text")


def detail_rows(p: Projection, stated: DataFrame, claims: DataFrame, now: int, budget: int = K.DETAIL_BYTES, most: int = K.DETAIL_ROWS) -> DataFrame:
    """Supporting texts of claims (claim_id, place): the newest first until the shared budget is used up, then in order of time."""
    live = p.claim_support.where("live = 1").join(claims, "claim_id").join(validity.live_statements(stated, now).select(F.col("id").alias("event_id"), "seq", "created_at", "raw_text"), "event_id")
    # of each claim only the first `most` rows can be shown, so the window without a key sees at most `most` for each of a request's claims
    own = Window.partitionBy("claim_id").orderBy(F.desc("seq"))
    live = live.withColumn("own", F.row_number().over(own)).where(F.col("own") <= most)
    by = Window.orderBy("place", F.desc("seq"))
    run = live.withColumn("n", F.row_number().over(by)).withColumn("bytes", F.sum(F.octet_length("raw_text")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where((F.col("n") <= most) & (F.col("bytes") <= budget)).orderBy("place", "created_at", "seq").select("claim_id", "event_id", "raw_text", "created_at")


def details(p: Projection, stated: DataFrame, claim_ids: list[str], now: int) -> dict[str, list[dict]]:
    spark = stated.sparkSession
    asked = F.broadcast(spark.createDataFrame(list(enumerate(claim_ids)), "place int, claim_id string"))  # at most LIMITS[1] rows
    out: dict[str, list[dict]] = {}
    for r in detail_rows(p, stated, asked, now).collect():
        out.setdefault(r["claim_id"], []).append({"event_id": r["event_id"], "raw_text": r["raw_text"], "created_at": r["created_at"]})
    return out
