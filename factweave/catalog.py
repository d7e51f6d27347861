"""Queries over the driver tables, one for each operator of the claims model, and their DuckDB SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factweave import constants as K, schema
from factweave.functions import identifiers as ids
from factweave.operators import answers, checks, fold, incremental, lookup, masking, prescan, projection, ranking, redirects, traversal, validity
from factweave.operators.projection import Projection
from factweave.plans import dispatch
from factweave.scratch import materialize, scratch_root
from factweave.sources import journalize
from factweave.sources.journalize import NOW

Query = Callable[[SparkSession, str], DataFrame]
_SHARED: dict[tuple, dict] = {}


def projected(spark: SparkSession, sf_dir: str) -> dict:
    """The events journal with its projection: written once for each input and session."""
    files = spark.read.parquet(f"{sf_dir}/events.parquet").inputFiles()
    key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted(files)))
    if key not in _SHARED:
        j = materialize(journalize.events_journal(spark, sf_dir), "journal")
        steps = projection.prepared(j)
        p = projection.project_prepared(steps)
        _SHARED[key] = {"j": j, "p": Projection(**{k: materialize(t, k) for k, t in p.tables().items()}), "stated": steps.stated, "steps": steps}
    return _SHARED[key]


def shared(spark: SparkSession, sf_dir: str) -> dict:
    """The events journal with its projection, aggregate and valid claims: written once for each input and session, as a stored projection is."""
    s = projected(spark, sf_dir)
    if "valid" not in s:
        s["agg"] = materialize(validity.claim_aggregate(s["p"], s["j"], NOW), "aggregate")
        s["valid"] = materialize(validity.valid_claims(s["p"], s["agg"]), "valid")
    return s


#: Columns that may be null are shown as double, so that both engines give one type for them.
_OPEN = ("expires_at", "effective_expires_at")


def _out(df: DataFrame) -> DataFrame:
    small = (T.IntegerType, T.ShortType)
    return df.select(*(F.col(f.name).cast("double" if f.name in _OPEN else "long").alias(f.name) if f.name in _OPEN or isinstance(f.dataType, small) else F.col(f.name) for f in df.schema))


def journal_scan(spark, d):
    j = prescan.parsed(shared(spark, d)["j"])
    return j.select("scope_key", "seq", "id", "kind", "created_at", F.col("b.supersedes").alias("supersedes"), F.coalesce("b.target.event_id", "b.target.claim_id").alias("target"))


def draft_explode(spark, d):
    x = prescan.occurrences(shared(spark, d)["stated"])
    return x.select("scope_key", "seq", "draft_index", "position", F.col("d.relation").alias("relation"), "subject_ref", "object_ref", "claim_ref")


def body_validation(spark, d):
    j = shared(spark, d)["j"]
    says, at, body = F.col("kind") == "statement", F.col("seq") % 1000, F.col("body")
    bad = F.when(at == 11, '{"raw_text":"x","parsed":[],"provenance":"nobody","ttl":"weeks"}').when(at == 12, "not json").when(at == 13, '{"raw_text":"x"}')
    bad = bad.when(at == 14, F.regexp_replace(body, '"relation":"[a-z_]*"', '"relation":"likes"')).when(at == 15, F.regexp_replace(body, r'"parsed":\[.*?\]', '"parsed":null')).when(at == 18, F.regexp_replace(body, r'"object(_value)?":"[^"]*"', '"object":"x","object_value":"y"'))
    undo = F.floor(F.col("seq") / 301) % 4
    odd = F.when(undo == 0, F.regexp_replace(body, ',"cascade":(true|false)', "")).when(undo == 1, F.regexp_replace(body, "ev_[0-9]*", "ev_" + "7" * 26)).when(undo == 2, '{"target":{}}')
    j = j.withColumn("body", F.when(says, F.coalesce(bad, body)).when(body.contains('"event_id"'), F.coalesce(odd, body)).otherwise(body))
    j = j.withColumn("id", F.when(says & (at == 16), F.concat(F.lit("x"), "id")).otherwise(F.col("id"))).withColumn("scope_key", F.when(says & (at == 17), "nowhere").otherwise(F.col("scope_key"))).withColumn("kind", F.when(says & (at == 19), "rumour").otherwise(F.col("kind")))
    return prescan.body_violations(j).groupBy("problem").agg(F.count("*").alias("n"))


def supersedes_root(spark, d):
    return prescan.roots(shared(spark, d)["j"]).select("scope_key", "seq", "root_seq", "parent")


def statement_state(spark, d):
    return shared(spark, d)["p"].statements.drop("expires_at")


def effective_stream(spark, d):
    return prescan.effective_stream(shared(spark, d)["j"])


def statement_expiry(spark, d):
    return shared(spark, d)["p"].statements.select("event_id", "expires_at")


def entity_dedup(spark, d):
    return shared(spark, d)["p"].entities.drop("merged_into")


def surface_forms(spark, d):
    return shared(spark, d)["p"].surface_forms


def id_redirects(spark, d):
    return shared(spark, d)["p"].id_redirects


def claim_state(spark, d):
    return shared(spark, d)["p"].claims


def claim_support_live(spark, d):
    return shared(spark, d)["p"].claim_support


def valid_support(spark, d):
    return validity.valid_supports(shared(spark, d)["p"], NOW).select("scope_key", "claim_id", "event_id", "draft_index", "created_at")


def claim_aggregate(spark, d):
    s = shared(spark, d)
    return validity.claim_aggregate(s["p"], s["j"], NOW)


def contested_claims(spark, d):
    return validity.contested(shared(spark, d)["valid"])


def _ranked(spark, d):
    s = shared(spark, d)
    return ranking.scored(s["agg"].select("scope_key", "claim_id", F.lit(0).alias("depth")), s["valid"], s["p"].entities, NOW)


def rank_topk(spark, d):
    return ranking.top(_ranked(spark, d), K.LIMIT).select("scope_key", "claim_id", "score", "text", "contested", "support_count", "place", "total", "more_available")


def overview_entities(spark, d):
    s = shared(spark, d)
    return lookup.overview_entities(s["valid"], s["p"].entities)


def overview_raw(spark, d):
    t = journalize.texts(spark, d).withColumn("created_at", F.lit(1_700_000_000) + F.col("seq") % 1000).withColumn("expires_at", F.when(F.col("seq") % 3 == 0, F.col("created_at") + 500))
    return lookup.overview_raw(t, 1_700_000_900).select("scope_key", "seq", "created_at", "place")


_TERMS = ["user 7", "item 5", "User-7", "ITEM_42", "nobody"]


def surface_seed_lookup(spark, d):
    terms = lookup.query_terms("ignored", _TERMS)
    return lookup.surface_seeds(shared(spark, d)["p"], lookup.values(spark, terms))


def phrase_match(spark, d):
    t = lookup.bm25(journalize.texts(spark, d), ["Released under", "token ="])
    return t.select("scope_key", "seq", "phrase")


def bm25_topk(spark, d):
    return lookup.search(journalize.texts(spark, d), ["licen", "tion the"]).select("scope_key", "seq", F.round("score", 6).alias("score"), "phrase")


def fts_raw_suppression(spark, d):
    t = journalize.texts(spark, d)
    return lookup.raw_only(t, t.where(F.col("seq") % 5 == 0)).select("scope_key", "seq")


def links_incidents(spark, d):
    return lookup.incidents(shared(spark, d)["valid"])


def hub_topk(spark, d):
    links, _ = traversal.ranked_incidents(shared(spark, d)["valid"])
    return links


def _bfs(spark, d):
    s = shared(spark, d)
    seeds = s["p"].entities.where(F.col("normal_name").isin("user4", "user5", "user6", "user7")).select(F.substring("scope_key", 3, 1).cast("int").alias("request_id"), "scope_key", F.col("id").alias("entity_id"), F.lit(0).alias("seed_order"), F.col("name").alias("display"))
    return traversal.traverse(seeds, s["valid"], s["p"].entities)


def bfs_reached(spark, d):
    return _bfs(spark, d)[1].select("scope_key", "claim_id", "depth")


def bfs_paths(spark, d):
    return _bfs(spark, d)[1].select("scope_key", "claim_id", "anchor_id", "path", "hops")


def invariants(spark, d):
    """On a copy with faults of seven kinds: how often each invariant is broken."""
    p = shared(spark, d)["p"]
    seq, part = F.substring("event_id", 4, 26).cast("long"), lambda c: ids.seq_of(F.col(c))
    bad = lambda when, value, c: F.when(when, value).otherwise(F.col(c))
    support = p.claim_support.withColumn("expires_at", bad(seq % 7 == 0, F.lit(1).cast("long"), "expires_at")).withColumn("scope_key", bad(seq % 17 == 0, F.lit("u:none/p:events"), "scope_key")).withColumn("live", bad(seq % 11 == 0, F.lit(0), "live"))
    claims = p.claims.withColumn("object_id", bad((F.col("origin_seq") % 13 == 0) & F.col("object_id").isNotNull(), F.lit("e0.9"), "object_id")).withColumn("object_value", bad(F.col("origin_seq") % 19 == 0, F.lit("both"), "object_value"))
    moved = p.id_redirects.withColumn("new_id", bad(part("old_id") % 23 == 0, F.lit("e0.9"), "new_id"))
    twice = p.entities.unionByName(p.entities.where("origin_seq % 5 = 0").withColumn("id", F.concat("id", F.lit("9"))))
    surfaces = p.surface_forms.withColumn("entity_id", bad(part("entity_id") % 3 == 0, F.lit("e0.9"), "entity_id"))
    return checks.violations(Projection(statements=p.statements, entities=twice, surface_forms=surfaces, claims=claims, claim_support=support, id_redirects=moved))


def refusals(spark, d):
    """What the set-based way refuses, by rule, on a journal in which some names are empty, some claims are stated twice, and some retracted claims aren't there or not yet."""
    j = shared(spark, d)["j"]
    seq, body = F.col("seq"), F.col("body")
    wrong = F.when((F.col("kind") == "statement") & (seq % 100 == 11), F.regexp_replace(body, r'"subject":"[^"]*"', '"subject":" - "'))
    wrong = wrong.when((F.col("kind") == "statement") & (seq % 100 == 13), F.regexp_replace(body, r'"parsed":\[(.*?)\]', '"parsed":[$1,$1]'))
    claim = body.contains('"claim_id"')
    wrong = wrong.when(claim & (seq % 2 == 0), F.regexp_replace(body, r'"c[0-9]+\.0"', '"c1.77"')).when(claim & (seq % 3 == 0), F.regexp_replace(body, r'"c[0-9]+\.0"', F.concat(F.lit('"c'), (seq + 5).cast("string"), F.lit('.0"'))))
    steps = projection.prepared(j.withColumn("body", F.coalesce(wrong, body)))
    resolved = projection.resolved_claims(steps.drafts, projection.entities_of(steps.mentioned.where("normal_name is not null")))
    return projection.refusals(steps, resolved).groupBy("scope_key", "problem").agg(F.count("*").alias("n"))


def row_counts(spark, d):
    return checks.row_counts(shared(spark, d)["p"])


def kind_conflicts(spark, d):
    """Entities to which live statements give several kinds: here an item's kind changes with every fourth event."""
    steps = shared(spark, d)["steps"]
    mixed = steps.mentioned.withColumn("kind", F.when((F.col("place") == 1) & (F.col("seq") % 4 == 0), "gadget").otherwise(F.col("kind")))
    found = projection.kind_conflicts(mixed, projection.entities_of(mixed))
    return found.select("scope_key", "id", F.array_join("kinds", ",").alias("kinds"))


def redirect_violations(spark, d):
    """On the events' chain with loops, unknown ids and several ways out."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    ref = lambda n: ids.make("e", n, F.lit(0))
    scope, kind = F.lit(journalize.CHAIN).alias("scope_key"), F.lit("entity").alias("kind")
    n = F.col("event_id")
    to = F.when(n % 7 == 3, n).when(n % 7 == 5, n + 10_000_000).otherwise(n - 1)
    r = e.where("event_id % 5 != 0").select(scope, ref(n).alias("old_id"), ref(to).alias("new_id"), kind, F.lit("merge").alias("reason"))
    more = e.where("event_id % 35 = 1").select(scope, ref(n).alias("old_id"), ref(n - 2).alias("new_id"), kind, F.lit("merge").alias("reason"))
    anchors = e.select(scope, ref(n).alias("id"), kind)
    found = redirects.violations(r.unionByName(more), anchors).where("problem in ('SELF_REDIRECT', 'DANGLING_REDIRECT', 'SEVERAL_REDIRECTS')")
    return found.groupBy("problem").agg(F.count("*").alias("n"))


def reinterpretation_candidates(spark, d):
    """Live inferred statements of the events journal at its fixed time."""
    from factweave.operators import writes

    stated = shared(spark, d)["stated"]
    return writes.reinterpretation_candidates(stated, NOW).select("scope_key", "id", "seq")


def trigram_postings(spark, d):
    """The search index over all documents: each text's trigrams, counted and added up."""
    t = lookup.postings(journalize.texts(spark, d))
    return t.groupBy("scope_key", "seq").agg(F.count("*").alias("trigrams"), F.sum(F.length("trigram").cast("long")).alias("points"))


def bm25_indexed(spark, d):
    """bm25_topk by way of the index: only rows that have all trigrams of a phrase are read."""
    t, wanted = journalize.texts(spark, d), ["licen", "tion the"]
    few = t.join(lookup.posted(lookup.postings(t), wanted), ["scope_key", "seq"], "left_semi")
    found = lookup.bm25(few, wanted, lookup.measured(t)).orderBy(F.round("score", 9), F.desc("seq")).limit(K.FTS_ROWS)
    return found.select("scope_key", "seq", F.round("score", 6).alias("score"), "phrase")


def expiry_mismatch(spark, d):
    """On a copy in which every seventh support's expiry is wrong."""
    s = shared(spark, d)
    ttl = s["stated"].select(F.col("id").alias("event_id"), "ttl")
    seq = F.substring("event_id", 4, 26).cast("long")
    broken = s["p"].claim_support.withColumn("expires_at", F.when(seq % 7 == 0, F.lit(1).cast("long")).otherwise(F.col("expires_at")))
    return checks.expiry_mismatches(s["p"].statements, broken, ttl)


def identity_dry_run(spark, d):
    """Customers and suppliers by name, under a rule that looks at the last digit only: groups that meet."""
    e = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("origin_seq"))
    e = e.withColumn("normal_name", F.lower("name")).withColumn("scope_key", F.lit("u:star/p:names")).withColumn("id", ids.make("e", F.col("origin_seq"), F.lit(0))).withColumn("merged_into", F.lit(None).cast("string"))
    return checks.identity_dry_run(e, lambda c: F.substring(c, 1, 1))


def rollout_metrics(spark, d):
    s = shared(spark, d)
    m = checks.rollout_metrics(s["p"].claims, s["agg"], validity.contested(s["valid"]))
    return m.select(*(F.round(c, 9).alias(c) if c in ("relates_share", "mean_support", "p95_support", "p99_support") else F.col(c) for c in m.columns))


def dispatch_mode(spark, d):
    """By scope, and once more without reinterpretations and for plain statements only, so that each reason is seen."""
    j = prescan.parsed(shared(spark, d)["j"])
    plain = j.where("b.supersedes is null")
    parts = {"all": j, "no_supersedes": plain, "statements": plain.where("kind = 'statement'")}
    return reduce(DataFrame.unionByName, (dispatch.mode(x).withColumn("part", F.lit(k)) for k, x in parts.items()))


def replay_reason(spark, d):
    s = shared(spark, d)
    meta = s["j"].groupBy("scope_key").agg(F.max("seq").alias("last_seq")).where("scope_key != 'u:0/p:events'").withColumn("rules_version", F.when(F.col("scope_key") == "u:1/p:events", 0).otherwise(K.RULES_VERSION)).withColumn("last_seq", F.when(F.col("scope_key") == "u:2/p:events", 1).otherwise(F.col("last_seq")))
    invalid = spark.createDataFrame([("u:3/p:events",)], "scope_key string")
    return dispatch.replay_reasons(s["j"], meta, invalid)


def upsert_changes(spark, d):
    """Statements of the journal's first half against all."""
    s = shared(spark, d)
    last = s["j"].agg(F.max("seq")).first()[0] or 0
    half = projection_of(s["j"].where(F.col("seq") <= last // 2)).statements
    return dispatch.changes(half, s["p"].statements, ["event_id"])


def projection_of(journal: DataFrame) -> Projection:
    return projection.project(materialize(journal, "journal"))


def star_contested(spark, d):
    c = journalize.star_claims(spark, d)
    c = c.select(F.lit("u:star/p:tpch").alias("scope_key"), F.concat_ws("/", "subject", "relation", "object").alias("claim_id"), F.col("subject").alias("subject_id"), "relation", F.col("object").alias("object_id"), F.lit(None).cast("string").alias("object_value"))
    return validity.contested(c)


def canonical_digest(spark, d):
    return checks.canonical_digest(shared(spark, d)["p"])


def fold_parity(spark, d):
    """The fold's tables against the set-based ones: rows of the fold, and rows that only one of them has, by table. Over the whole journal."""
    s = projected(spark, d)
    return differing(s["p"].tables(), fold.project(s["steps"].events).tables())


def differing(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, n): rows of the second of two projections, and rows that only one has, by table."""
    found = []
    for name, s in schema.TABLES.items():
        x, y = (t[name].select(*s.names).groupBy(*s.names).agg(F.count("*").alias(c)) for t, c in ((a, "x"), (b, "y")))
        on = reduce(lambda p, q: p & q, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in s.names))
        both = x.alias("a").join(y.alias("b"), on, "full_outer").select(F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
        found.append(both.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.abs(F.col("x") - F.col("y"))), F.lit(0)).alias("n")).select(F.lit(name).alias("name"), "rows", "n"))
    return reduce(DataFrame.unionByName, found)


def _decided(spark, d, written: tuple[str, ...] = tuple(schema.TABLES)) -> tuple[Projection, DataFrame]:
    """The journal with merges, aliases and several drafts a statement, and its projection through the choice between both ways. written: the tables that are read more than once."""
    j = materialize(journalize.decided_journal(spark, d), "decided")
    return Projection(**{k: materialize(t, k) if k in written else t for k, t in dispatch.project(j).tables().items()}), j


def rollout_labels(spark, d):
    p, j = _decided(spark, d, ("claims",))
    return checks.top_labels(validity.valid_claims(p, validity.claim_aggregate(p, j, NOW)), 3)


def merge_alias_projection(spark, d):
    """The whole journal with merges, aliases and several drafts a statement: claims, and what holds of them."""
    p, j = _decided(spark, d)
    agg = validity.claim_aggregate(p, j, NOW).select("scope_key", F.col("claim_id").alias("id"), "support_count", "relation_label")
    return p.claims.select("id", "scope_key", "subject_id", "relation", "object_id", "object_value", "state", "origin_seq").join(agg, ["scope_key", "id"], "left").withColumn("support_count", F.coalesce("support_count", F.lit(0)))


def reference_resolution(spark, d):
    """What names lead to after merges and aliases: entities by name or confirmed name, merged ones at their place."""
    from factweave.operators import writes

    p, _ = _decided(spark, d, ("entities", "surface_forms"))
    names, rows = [f"{p}{n}" for p in ("user", "aluser", "item") for n in range(20)], []
    for scope in (f"u:{i}/p:events" for i in range(4)):
        hits = writes.name_hits(p, scope, set(names))
        found = {n: writes.decided(hits.get(n, []), n) for n in names}
        rows += [(scope, n, f["status"], f.get("entity_id")) for n, f in found.items()]
    return spark.createDataFrame(rows, "scope_key string, name string, status string, entity_id string")


def incremental_vs_replay(spark, d):
    """Projections after appending the whole journal in three batches, scope by scope, against one replay: rows of the six tables, and rows that only one of them has."""
    s = shared(spark, d)
    j, grown, before = s["j"], None, 0
    last = j.agg(F.max("seq")).first()[0] or 0
    for limit in (last // 3, 2 * last // 3, last):
        part = j.where(F.col("seq") <= limit)
        touched = materialize(part.where(F.col("seq") > before).select("scope_key").distinct(), "touched")
        fresh = projection_of(part.join(touched, "scope_key", "left_semi")).tables()
        fresh = {k: materialize(t, "incremental") for k, t in fresh.items()}
        grown = fresh if grown is None else {k: dispatch.replaced(grown[k], t, touched) for k, t in fresh.items()}
        before = limit
    return differing(s["p"].tables(), grown)


def incremental_reducer(spark, d):
    """Thirds of the journal's statements and claim retractions, the second and third by the incremental reducer, against one replay: rows of the six tables, and rows that only one of them has."""
    j = prescan.parsed(shared(spark, d)["j"]).where("b.supersedes is null and b.target.event_id is null").drop("b")
    j = materialize(j, "additions")
    last = j.agg(F.max("seq")).first()[0] or 0
    cuts = [0, last // 3, 2 * last // 3, last]
    grown = projection.project(j.where(F.col("seq") <= cuts[1]))
    for a, b in zip(cuts[1:], cuts[2:]):
        new = j.where(F.col("seq").between(a + 1, b))
        if not incremental.replayed_scopes(grown, new).isEmpty():
            raise RuntimeError("REPLAY_NEEDED")
        grown = incremental.advance(grown, j.where(F.col("seq") <= a), new)
        grown = Projection(**{k: materialize(t.select(*schema.TABLES[k].names), k) for k, t in grown.tables().items()})
    return differing(projection.project(j).tables(), grown.tables())


def redirect_compression(spark, d):
    """Chains of up to four hops over the events' ids: each id leads to the one before, but for multiples of five."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_id % 5 != 0").select(F.lit(journalize.CHAIN).alias("scope_key"), "event_id")
    ref = lambda n: ids.make("e", n, F.lit(0))
    r = e.select("scope_key", ref(F.col("event_id")).alias("old_id"), ref(F.col("event_id") - 1).alias("new_id"), F.lit("entity").alias("kind"), F.lit("merge").alias("reason"))
    return redirects.compressed(r)


def surface_dump(spark, d):
    """Surface forms as canonical JSON, one line for each."""
    s = shared(spark, d)["p"].surface_forms
    return s.select("scope_key", F.to_json(F.struct("surface_norm", "entity_id", "origin")).alias("line"))


def assembled_answer(spark, d):
    """The assembled answer to one request."""
    s = shared(spark, d)
    a = answers.answer(s["p"], s["j"], answers.Request("u:1/p:events", query="user 5"), NOW)
    rows = [(a.entry, c["place"], c["claim_id"], c["text"], c["score"], c["depth"], c["path"]) for c in a.claims]
    return spark.createDataFrame(rows, "entry string, place int, claim_id string, text string, score long, depth int, path string")


def mask_secrets(spark, d):
    t = journalize.texts(spark, d)
    return t.select("seq", masking.mask("raw_text").alias("masked")).select("seq", F.sha2("masked", 256).alias("digest"), F.contains("masked", F.lit("[REDACTED:")).alias("hit"))


def stream_projection(spark, d):
    """The whole events journal in files, through the streaming projector: rows of the six tables by scope."""
    from factweave.streaming import projector

    base = f"{scratch_root(spark)}/factweave/stream-{uuid.uuid4().hex}"
    shared(spark, d)["j"].repartitionByRange(2, "seq").write.parquet(f"{base}/in")
    q = projector.project_stream(projector.journal_stream(spark, f"{base}/in"), f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return checks.row_counts(dispatch.Store(spark, f"{base}/out").current().projection())


def queries() -> dict[str, Query]:
    own = (
        claim_aggregate, journal_scan, draft_explode, body_validation, supersedes_root, statement_state, effective_stream, statement_expiry, entity_dedup, surface_forms, id_redirects, claim_state, claim_support_live, valid_support,
        contested_claims, rank_topk, overview_entities, overview_raw, surface_seed_lookup, phrase_match, bm25_topk, fts_raw_suppression, links_incidents, hub_topk, bfs_reached, bfs_paths, invariants, expiry_mismatch,
        identity_dry_run, rollout_metrics, dispatch_mode, replay_reason, upsert_changes, star_contested, canonical_digest, fold_parity, merge_alias_projection, incremental_vs_replay, incremental_reducer, redirect_compression, surface_dump, assembled_answer, mask_secrets, stream_projection,
        refusals, row_counts, kind_conflicts, redirect_violations, reinterpretation_candidates, trigram_postings, bm25_indexed, reference_resolution, rollout_labels,
    )
    return {f.__name__: (lambda spark, d, f=f: _out(f(spark, d))) for f in own}


def _case(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_EV = f"""ev0 AS (SELECT event_id + 1 AS seq, user_id, event_type, json_extract_string(props, '$.k') AS k, 'u:' || (user_id % 4) || '/p:events' AS scope_key, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
  {_case("event_type", journalize._RELATION)} AS relation, {_case("event_type", journalize._PROVENANCE)} AS provenance, {_case("event_type", journalize._TTL)} AS ttl,
  (event_id + 1) % 301 <> 5 AND (event_id + 1) % 97 <> 0 AND (event_id + 1) % 50 <> 7 AS plain FROM events),
ev1 AS (SELECT *, CASE WHEN lag(plain) OVER w THEN lag(seq) OVER w END AS prev FROM ev0 WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
ev AS (SELECT *, 'ev_' || lpad(CAST(seq AS VARCHAR), 26, '0') AS id, CASE WHEN seq % 301 = 5 AND prev IS NOT NULL THEN 'event_retraction' WHEN seq % 97 = 0 AND prev IS NOT NULL THEN 'claim_retraction' ELSE 'statement' END AS what FROM ev1),
s0 AS (SELECT *, CASE WHEN seq % 50 = 7 THEN prev END AS parent, coalesce(CASE WHEN seq % 50 = 7 THEN prev END, seq) AS root FROM ev WHERE what = 'statement'),
whole AS (SELECT x.root, max(r.seq) AS upto FROM ev r JOIN s0 x ON x.seq = r.prev WHERE r.what = 'event_retraction' AND r.seq % 2 = 0 GROUP BY ALL),
dead AS (SELECT s.seq FROM s0 s JOIN ev r ON r.prev = s.seq WHERE r.what = 'event_retraction' UNION SELECT s.seq FROM s0 s JOIN whole w ON w.root = s.root WHERE s.seq < w.upto),
s1 AS (SELECT s.seq, s.id, s.scope_key, s.user_id, s.k, s.relation, s.parent, s.root, r.sec, r.provenance, r.ttl, CASE r.ttl WHEN 'session' THEN r.sec + 43200 WHEN 'weeks' THEN r.sec + 2592000 END AS expires_at,
  CASE WHEN s.seq IN (SELECT seq FROM dead) THEN 'retracted' WHEN s.seq IN (SELECT parent FROM s0 WHERE parent IS NOT NULL AND seq NOT IN (SELECT seq FROM dead)) THEN 'superseded' ELSE 'live' END AS state
  FROM s0 s JOIN ev r ON r.seq = s.root),
m AS (SELECT scope_key, seq, 0 AS pos, 'user' || user_id AS norm, 'user ' || user_id AS name, 'person' AS kind, state, root FROM s1
  UNION ALL SELECT scope_key, seq, 1, 'item' || k, 'item ' || k, 'thing', state, root FROM s1 WHERE relation <> 'describes'),
ent AS (SELECT scope_key, norm, min(seq * 10 + pos) AS code, arg_min(name, seq * 10 + pos) AS name, arg_min(state, seq * 10 + pos) AS own_state, bool_or(state = 'live') AS said, arg_min(kind, seq) FILTER (state = 'live') AS kind FROM m GROUP BY ALL),
en AS (SELECT *, 'e' || (code // 10) || '.' || (code % 10) AS eid, code // 10 AS origin_seq FROM ent),
d0 AS (SELECT s.*, a.eid AS subject_id, b.eid AS object_id, CASE WHEN relation = 'describes' THEN 'tier ' || (s.seq % 3) END AS literal FROM s1 s
  JOIN en a ON a.scope_key = s.scope_key AND a.norm = 'user' || s.user_id LEFT JOIN en b ON b.scope_key = s.scope_key AND b.norm = 'item' || s.k AND relation <> 'describes'),
d1 AS (SELECT *, min(seq) OVER (PARTITION BY scope_key, subject_id, relation, object_id, literal) AS cseq FROM d0),
d AS (SELECT *, 'c' || cseq || '.0' AS claim_id FROM d1),
ret AS (SELECT d.scope_key, d.claim_id, max(r.seq) AS r FROM ev r JOIN d ON r.what = 'claim_retraction' AND d.seq = r.prev GROUP BY ALL),
sup AS (SELECT d.*, CASE WHEN state = 'live' AND root > coalesce(r, 0) THEN 1 ELSE 0 END AS live FROM d LEFT JOIN ret USING (scope_key, claim_id)),
c0 AS (SELECT scope_key, claim_id, any_value(subject_id) AS subject_id, any_value(relation) AS relation, any_value(object_id) AS object_id, any_value(literal) AS literal, any_value(cseq) AS origin_seq,
  max(CASE WHEN state = 'live' THEN root * 100000000 + seq END) AS act, arg_min(sec, seq) AS anchor_at, min(CASE WHEN live = 1 THEN sec END) AS first_at, max(CASE WHEN live = 1 THEN sec END) AS last_at FROM sup GROUP BY ALL),
c AS (SELECT *, CASE WHEN act IS NULL OR coalesce(r, 0) > act // 100000000 THEN 'retracted' WHEN relation = 'describes' AND max(act) OVER (PARTITION BY scope_key, subject_id, relation = 'describes') > act THEN 'superseded' ELSE 'active' END AS cstate FROM c0 LEFT JOIN ret USING (scope_key, claim_id)),
v AS (SELECT sup.* FROM sup JOIN c USING (scope_key, claim_id) WHERE live = 1 AND sup.state = 'live' AND cstate = 'active' AND (expires_at IS NULL OR expires_at > {NOW})),
agg AS (SELECT scope_key, claim_id, count(*) AS support_count, max(CASE provenance WHEN 'user_stated' THEN 3 WHEN 'observed' THEN 2 ELSE 1 END)::BIGINT AS strongest_rank, max(sec) AS last_seen_at,
  max(CASE WHEN relation = 'relates_to' THEN 'viewed' END) AS relation_label, CASE WHEN count(*) = count(expires_at) THEN max(expires_at) END AS effective_expires_at FROM v GROUP BY ALL),
vc AS (SELECT agg.*, c.subject_id, c.relation, c.object_id, c.literal, c.origin_seq FROM agg JOIN c USING (scope_key, claim_id)),
con AS (SELECT scope_key, claim_id FROM vc a WHERE relation IN ('uses', 'rejects') AND EXISTS (SELECT 1 FROM vc b WHERE b.scope_key = a.scope_key AND b.subject_id = a.subject_id AND b.object_id IS NOT DISTINCT FROM a.object_id AND b.literal IS NOT DISTINCT FROM a.literal AND b.relation = CASE a.relation WHEN 'uses' THEN 'rejects' ELSE 'uses' END)),
inc AS (SELECT scope_key, subject_id AS from_id, claim_id, object_id AS to_id FROM vc UNION ALL SELECT scope_key, object_id, claim_id, subject_id FROM vc WHERE object_id IS NOT NULL AND object_id <> subject_id),
rnk AS (SELECT i.*, row_number() OVER (PARTITION BY scope_key, from_id ORDER BY support_count DESC, strongest_rank DESC, last_seen_at DESC, origin_seq, claim_id) AS ri FROM inc i JOIN agg USING (scope_key, claim_id) JOIN (SELECT scope_key, claim_id, origin_seq FROM c) USING (scope_key, claim_id)),
lnk AS (SELECT i.scope_key, i.from_id, i.claim_id, i.to_id, row_number() OVER (PARTITION BY scope_key, from_id ORDER BY support_count DESC, strongest_rank DESC, last_seen_at DESC, origin_seq, claim_id) AS rank FROM inc i JOIN agg USING (scope_key, claim_id) JOIN (SELECT scope_key, claim_id, origin_seq FROM c) USING (scope_key, claim_id) WHERE to_id IS NOT NULL)"""

#: Each step is computed once, however many others read it.
_EV = re.sub(r"^(\s*)(\w+) AS \(SELECT", r"\1\2 AS MATERIALIZED (SELECT", _EV, flags=re.M)

_TX = "tx AS (SELECT doc_id + 1 AS seq, 'u:docs/p:' || lang AS scope_key, text AS raw_text, lower(text) AS t, greatest(length(text) - 2, 0) AS len FROM documents)"


def _hits(phrase: str) -> str:
    """Overlapping occurrences of a phrase, counted by places."""
    return f"list_sum(list_transform(range(1, length(t) - {len(phrase) - 2}), lambda i: CASE WHEN t[i:i + {len(phrase) - 1}] = '{phrase}' THEN 1 ELSE 0 END))"


def _oracles() -> dict[str, str]:
    q = {
        "claim_aggregate": "SELECT * REPLACE (effective_expires_at::DOUBLE AS effective_expires_at) FROM agg",
        "journal_scan": """SELECT scope_key, seq, id, CASE what WHEN 'statement' THEN 'statement' ELSE 'retraction' END AS kind, sec AS created_at, CASE WHEN what = 'statement' AND seq % 50 = 7 AND prev IS NOT NULL THEN 'ev_' || lpad(CAST(prev AS VARCHAR), 26, '0') END AS supersedes,
          CASE what WHEN 'event_retraction' THEN 'ev_' || lpad(CAST(prev AS VARCHAR), 26, '0') WHEN 'claim_retraction' THEN 'c' || prev || '.0' END AS target FROM ev""",
        "draft_explode": "SELECT scope_key, seq, 0::BIGINT AS draft_index, 0::BIGINT AS position, relation, 'e' || seq || '.0' AS subject_ref, CASE WHEN relation <> 'describes' THEN 'e' || seq || '.1' END AS object_ref, 'c' || seq || '.0' AS claim_ref FROM s1",
        "body_validation": """SELECT problem, count(*) AS n FROM (SELECT CASE seq % 1000 WHEN 11 THEN 'INVALID_ENUM' WHEN 12 THEN 'INVALID_JSON_BODY' WHEN 13 THEN 'INVALID_BODY_KEYS' WHEN 14 THEN 'INVALID_DRAFT' WHEN 15 THEN 'INVALID_DRAFTS' WHEN 16 THEN 'INVALID_EVENT_ID' WHEN 17 THEN 'INVALID_SCOPE_KEY' WHEN 18 THEN 'INVALID_DRAFT' WHEN 19 THEN 'INVALID_KIND' END AS problem FROM ev WHERE what = 'statement'
          UNION ALL SELECT CASE WHEN (seq // 301) % 4 = 2 THEN 'INVALID_TARGET' WHEN (seq // 301) % 4 = 1 OR prev % 1000 IN (16, 17) THEN 'TARGET_NOT_FOUND' WHEN (seq // 301) % 4 = 0 AND prev % 1000 <> 19 THEN 'CASCADE_MISSING' END FROM ev WHERE what = 'event_retraction') WHERE problem IS NOT NULL GROUP BY ALL""",
        "supersedes_root": "SELECT scope_key, seq, root AS root_seq, CASE WHEN parent IS NOT NULL THEN 'ev_' || lpad(CAST(parent AS VARCHAR), 26, '0') END AS parent FROM s0",
        "statement_state": "SELECT id AS event_id, scope_key, state, root AS order_seq, sec AS created_at, provenance FROM s1",
        "effective_stream": "SELECT scope_key, id, 'statement' AS kind, root AS order_seq, seq FROM s1 WHERE state = 'live' UNION ALL SELECT scope_key, id, 'retraction', seq, seq FROM ev WHERE what <> 'statement'",
        "statement_expiry": "SELECT id AS event_id, expires_at::DOUBLE AS expires_at FROM s1",
        "entity_dedup": "SELECT eid AS id, scope_key, name, norm AS normal_name, kind, origin_seq FROM en",
        "surface_forms": "SELECT scope_key, norm AS surface_norm, eid AS entity_id, CASE own_state WHEN 'live' THEN 'name' ELSE 'agent_supplied' END AS origin FROM en WHERE said",
        "id_redirects": """SELECT m.scope_key, 'e' || seq || '.' || pos AS old_id, eid AS new_id, 'entity' AS kind, 'deduplicated' AS reason FROM m JOIN en USING (scope_key, norm) WHERE seq * 10 + pos <> code
          UNION ALL SELECT scope_key, 'c' || seq || '.0', claim_id, 'claim', 'deduplicated' FROM d WHERE seq <> cseq""",
        "claim_state": "SELECT claim_id AS id, scope_key, subject_id, relation, object_id, literal AS object_value, cstate AS state, origin_seq, coalesce(first_at, anchor_at) AS first_seen_at, coalesce(last_at, anchor_at) AS last_seen_at FROM c",
        "claim_support_live": "SELECT scope_key, claim_id, id AS event_id, 0::BIGINT AS draft_index, live::BIGINT AS live, expires_at::DOUBLE AS expires_at FROM sup",
        "valid_support": "SELECT scope_key, claim_id, id AS event_id, 0::BIGINT AS draft_index, sec AS created_at FROM v",
        "contested_claims": "SELECT * FROM con",
        "rank_topk": f"""SELECT scope_key, claim_id, score, text, contested, support_count, place, total, CASE WHEN total > {K.LIMIT} THEN 1 ELSE 0 END::BIGINT AS more_available FROM (
          SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY score DESC, strongest_rank DESC, support_count DESC, last_seen_at DESC, origin_seq, claim_id) AS place, count(*) OVER (PARTITION BY scope_key) AS total FROM (
          SELECT vc.*, (CASE WHEN con.claim_id IS NULL THEN 0 ELSE 1 END)::BIGINT AS contested, a.name || ' ' || coalesce(relation_label, {_case("relation", K.PREDICATES)}) || ' ' || coalesce(b.name, literal) AS text,
          (CASE strongest_rank WHEN 3 THEN 6 WHEN 2 THEN 4 ELSE 1 END + least(support_count, 4) + CASE WHEN last_seen_at BETWEEN {NOW - K.RECENT} AND {NOW} THEN 2 ELSE 0 END - CASE WHEN con.claim_id IS NULL THEN 0 ELSE 3 END)::BIGINT AS score
          FROM vc LEFT JOIN con USING (scope_key, claim_id) JOIN en a ON a.scope_key = vc.scope_key AND a.eid = subject_id LEFT JOIN en b ON b.scope_key = vc.scope_key AND b.eid = object_id)) WHERE place <= {K.LIMIT}""",
        "overview_entities": f"""SELECT scope_key, entity_id, incident_claims, last_seen_at, place, name FROM (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY incident_claims DESC, last_seen_at DESC, code) AS place FROM (
          SELECT i.scope_key, i.from_id AS entity_id, count(DISTINCT i.claim_id) AS incident_claims, max(last_seen_at) AS last_seen_at, any_value(en.code) AS code, any_value(en.name) AS name FROM inc i JOIN agg USING (scope_key, claim_id) JOIN en ON en.scope_key = i.scope_key AND en.eid = i.from_id GROUP BY ALL)) WHERE place <= {K.OVERVIEW_SEEDS}""",
        "surface_seed_lookup": """SELECT scope_key, entity_id, matched_term, surface_norm, seed_order, 0::BIGINT AS more FROM (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY o, entity_id) - 1 AS seed_order FROM (
          SELECT scope_key, eid AS entity_id, min(o) AS o, arg_min(term, o) AS matched_term, arg_min(norm, o) AS surface_norm FROM en JOIN (VALUES (0, 'user 7', 'user7'), (1, 'item 5', 'item5'), (2, 'User-7', 'user7'), (3, 'ITEM_42', 'item42'), (4, 'nobody', 'nobody')) q(o, term, n) ON norm = n WHERE said GROUP BY ALL))""",
        "links_incidents": "SELECT * FROM inc",
        "hub_topk": f"SELECT scope_key, from_id, claim_id, to_id, rank, max(CASE WHEN rank > {K.FANOUT} THEN 1 ELSE 0 END) OVER (PARTITION BY scope_key, from_id)::BIGINT AS more FROM lnk QUALIFY rank <= {K.FANOUT}",
        "invariants": """SELECT 'claim_subject_missing' AS problem, 0::BIGINT AS n UNION ALL SELECT 'claim_object_missing', count(*) FROM c WHERE object_id IS NOT NULL AND origin_seq % 13 = 0
          UNION ALL SELECT 'claim_object_xor_literal', count(*) FROM c WHERE object_id IS NOT NULL AND origin_seq % 19 = 0
          UNION ALL SELECT 'active_claim_without_live_support', count(*) FROM c WHERE cstate = 'active' AND (scope_key, claim_id) NOT IN (SELECT scope_key, claim_id FROM sup WHERE live = 1 AND seq % 11 <> 0 AND seq % 17 <> 0)
          UNION ALL SELECT 'support_without_claim', count(*) FROM sup WHERE seq % 17 = 0 UNION ALL SELECT 'support_without_statement', 0 UNION ALL SELECT 'support_scope_mismatch', count(*) FROM sup WHERE seq % 17 = 0
          UNION ALL SELECT 'support_expiry_mismatch', count(*) FROM sup WHERE seq % 7 = 0 UNION ALL SELECT 'redirect_target_missing', (SELECT count(*) FROM m JOIN en USING (scope_key, norm) WHERE seq * 10 + pos <> code AND seq % 23 = 0) + (SELECT count(*) FROM d WHERE seq <> cseq AND seq % 23 = 0)
          UNION ALL SELECT 'surface_without_entity', count(*) FROM en WHERE said AND origin_seq % 3 = 0
          UNION ALL SELECT 'several_active_describes', count(*) FROM (SELECT scope_key, subject_id FROM c WHERE cstate = 'active' AND relation = 'describes' GROUP BY ALL HAVING count(*) > 1)
          UNION ALL SELECT 'duplicate_active_identity', count(*) FROM (SELECT scope_key, subject_id, relation, CASE WHEN origin_seq % 13 = 0 AND object_id IS NOT NULL THEN 'e0.9' ELSE object_id END AS o, CASE WHEN origin_seq % 19 = 0 THEN 'both' ELSE literal END AS l FROM c WHERE cstate = 'active' GROUP BY ALL HAVING count(*) > 1)
          UNION ALL SELECT 'redirect_unlike_merge', 0 UNION ALL SELECT 'duplicate_entity_name', count(*) FROM en WHERE origin_seq % 5 = 0""",
        "refusals": """SELECT scope_key, 'EMPTY_NAME' AS problem, count(*) AS n FROM s1 WHERE seq % 100 = 11 GROUP BY ALL UNION ALL SELECT scope_key, 'DUPLICATE_STATEMENT_CLAIM', count(*) FROM s1 WHERE seq % 100 = 13 AND state = 'live' GROUP BY ALL
          UNION ALL SELECT scope_key, CASE WHEN seq % 2 = 0 THEN 'CLAIM_RETRACTION_TARGET_NOT_FOUND' ELSE 'CLAIM_RETRACTION_TARGET_NOT_PAST' END, count(*) FROM ev WHERE what = 'claim_retraction' AND (seq % 2 = 0 OR seq % 3 = 0) GROUP BY ALL""",
        "row_counts": """SELECT scope_key, 'statements' AS name, count(*) AS n FROM s1 GROUP BY ALL UNION ALL SELECT scope_key, 'entities', count(*) FROM en GROUP BY ALL UNION ALL SELECT scope_key, 'surface_forms', count(*) FROM en WHERE said GROUP BY ALL
          UNION ALL SELECT scope_key, 'claims', count(*) FROM c GROUP BY ALL UNION ALL SELECT scope_key, 'claim_support', count(*) FROM sup GROUP BY ALL
          UNION ALL SELECT scope_key, 'id_redirects', count(*) FROM (SELECT m.scope_key FROM m JOIN en USING (scope_key, norm) WHERE seq * 10 + pos <> code UNION ALL SELECT scope_key FROM d WHERE seq <> cseq) GROUP BY ALL""",
        "kind_conflicts": """SELECT scope_key, eid AS id, 'gadget,thing' AS kinds FROM en JOIN m USING (scope_key, norm) WHERE pos = 1 AND m.state = 'live' GROUP BY ALL HAVING bool_or(seq % 4 = 0) AND bool_or(seq % 4 <> 0)""",
        "reinterpretation_candidates": f"SELECT scope_key, id, seq FROM s1 WHERE state = 'live' AND provenance = 'inferred' AND (expires_at IS NULL OR expires_at > {NOW})",
        "expiry_mismatch": "SELECT 0::BIGINT AS statement_expiry, count(*) FILTER (seq % 7 = 0) AS support_expiry, 0::BIGINT AS scope_mismatch FROM sup",
        "rollout_metrics": """SELECT scope_key, claims, active, retracted, superseded, round(relates_share, 9) AS relates_share, round(mean_support, 9) AS mean_support, round(p95_support, 9) AS p95_support, round(p99_support, 9) AS p99_support, coalesce(contested, 0) AS contested FROM (
          SELECT scope_key, count(*) AS claims, count(*) FILTER (cstate = 'active') AS active, count(*) FILTER (cstate = 'retracted') AS retracted, count(*) FILTER (cstate = 'superseded') AS superseded, avg(CASE WHEN relation = 'relates_to' THEN 1.0 ELSE 0.0 END) AS relates_share FROM c GROUP BY ALL)
          LEFT JOIN (SELECT scope_key, avg(support_count) AS mean_support, quantile_cont(support_count::DOUBLE, 0.95) AS p95_support, quantile_cont(support_count::DOUBLE, 0.99) AS p99_support FROM agg GROUP BY ALL) USING (scope_key) LEFT JOIN (SELECT scope_key, count(*) AS contested FROM con GROUP BY ALL) USING (scope_key)""",
        "dispatch_mode": """SELECT scope_key, part, CASE WHEN o OR u THEN 'replay' ELSE 'incremental' END AS mode, CASE WHEN o THEN 'supersedes' WHEN u THEN 'event_retraction' ELSE 'append_only' END AS reason FROM (
          SELECT scope_key, part, bool_or(over) AS o, bool_or(what = 'event_retraction') AS u FROM (SELECT *, what = 'statement' AND seq % 50 = 7 AND prev IS NOT NULL AS over FROM ev) JOIN (VALUES ('all'), ('no_supersedes'), ('statements')) t(part)
          ON part = 'all' OR (NOT over AND (part = 'no_supersedes' OR what = 'statement')) GROUP BY ALL)""",
        "replay_reason": "SELECT DISTINCT scope_key, CASE scope_key WHEN 'u:0/p:events' THEN 'missing_meta' WHEN 'u:1/p:events' THEN 'rules_version_changed' WHEN 'u:2/p:events' THEN 'journal_sequence_changed' ELSE 'projection_invariant_failed' END AS reason FROM ev",
        "bfs_reached": f"""SELECT scope_key, claim_id, min(lv)::BIGINT AS depth FROM (SELECT scope_key, eid AS id, 0 AS lv FROM en WHERE norm IN ('user4', 'user5', 'user6', 'user7')
          UNION ALL SELECT scope_key, id, 1 FROM l1 UNION ALL SELECT scope_key, id, 2 FROM l2) x JOIN rnk USING (scope_key) WHERE from_id = id AND ri <= {K.FANOUT} GROUP BY ALL""",
    }
    extra = {
        "bfs_reached": f""", l1 AS (SELECT DISTINCT lnk.scope_key, to_id AS id FROM lnk JOIN en ON en.scope_key = lnk.scope_key AND en.eid = from_id WHERE norm IN ('user4', 'user5', 'user6', 'user7') AND rank <= {K.FANOUT} AND to_id <> from_id),
          l2 AS (SELECT DISTINCT lnk.scope_key, to_id AS id FROM lnk JOIN l1 ON l1.scope_key = lnk.scope_key AND l1.id = from_id WHERE rank <= {K.FANOUT}
          AND (lnk.scope_key, to_id) NOT IN (SELECT scope_key, id FROM l1) AND (lnk.scope_key, to_id) NOT IN (SELECT scope_key, eid FROM en WHERE norm IN ('user4', 'user5', 'user6', 'user7')))""",
    }
    out = {k: f"WITH {_EV}{extra.get(k, '')} {v}" for k, v in q.items()}
    n = lambda p: f"(SELECT count(*) FILTER (contains(t, '{p}')) FROM tx)"
    idf = lambda p: f"(SELECT CASE WHEN ln(((SELECT count(*) FROM tx) - {n(p)} + 0.5) / ({n(p)} + 0.5)) <= 0 THEN 1e-6 ELSE ln(((SELECT count(*) FROM tx) - {n(p)} + 0.5) / ({n(p)} + 0.5)) END)"
    part = lambda p: f"(CASE WHEN contains(t, '{p}') THEN {idf(p)} * {_hits(p)} * 2.2 / ({_hits(p)} + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM tx))) ELSE 0 END)"
    out["phrase_match"] = f"WITH {_TX} SELECT scope_key, seq, CASE WHEN contains(t, 'released under') THEN 0 ELSE 1 END::BIGINT AS phrase FROM tx WHERE contains(t, 'released under') OR contains(t, 'token =')"
    out["bm25_topk"] = f"WITH {_TX} SELECT scope_key, seq, round(-s, 6) AS score, phrase FROM (SELECT *, {part('licen')} + {part('tion the')} AS s, CASE WHEN contains(t, 'licen') THEN 0 ELSE 1 END::BIGINT AS phrase FROM tx WHERE contains(t, 'licen') OR contains(t, 'tion the')) ORDER BY round(-s, 9), seq DESC LIMIT {K.FTS_ROWS}"
    out["fts_raw_suppression"] = f"WITH {_TX} SELECT scope_key, seq FROM tx WHERE (scope_key, raw_text) NOT IN (SELECT scope_key, raw_text FROM tx WHERE seq % 5 = 0)"
    out["overview_raw"] = f"WITH {_TX} SELECT scope_key, seq, created_at, place FROM (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY created_at DESC, seq DESC) AS place FROM (SELECT scope_key, seq, 1700000000 + seq % 1000 AS created_at FROM tx) WHERE seq % 3 <> 0 OR created_at + 500 > 1700000900) WHERE place <= {K.LIMIT}"
    out["identity_dry_run"] = """WITH e AS (SELECT 'u:star/p:names' AS scope_key, 'e' || c_custkey || '.0' AS id, lower(c_mktsegment) AS normal_name, substr(c_mktsegment, 1, 1) AS new_name, c_custkey AS o FROM customer)
      SELECT scope_key, id, groups, CASE WHEN groups > 1 THEN 1 ELSE 0 END::BIGINT AS blocked, 'e' || k || '.0' AS new_id FROM e JOIN (SELECT normal_name, count(DISTINCT new_name) AS groups FROM e GROUP BY ALL) USING (normal_name) JOIN (SELECT new_name, min(o) AS k FROM e GROUP BY ALL) USING (new_name)"""
    out["star_contested"] = """WITH u AS (SELECT DISTINCT n_name, p_brand, CASE l_returnflag WHEN 'R' THEN 'rejects' ELSE 'uses' END AS relation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
      SELECT 'u:star/p:tpch' AS scope_key, n_name || '/' || relation || '/' || p_brand AS claim_id FROM u a WHERE EXISTS (SELECT 1 FROM u b WHERE b.n_name = a.n_name AND b.p_brand = a.p_brand AND b.relation <> a.relation)"""
    out["redirect_compression"] = f"SELECT '{journalize.CHAIN}' AS scope_key, 'e' || event_id || '.0' AS old_id, 'e' || (event_id // 5 * 5) || '.0' AS new_id, 'entity' AS kind, 'merge' AS reason, event_id % 5 AS hops FROM events WHERE event_id % 5 <> 0"
    out["surface_dump"] = f"""WITH {_EV} SELECT scope_key, '{{"surface_norm":"' || norm || '","entity_id":"' || eid || '","origin":"' || CASE own_state WHEN 'live' THEN 'name' ELSE 'agent_supplied' END || '"}}' AS line FROM en WHERE said"""
    early = _EV.replace("FROM events)", "FROM events WHERE event_id + 1 <= (SELECT max(event_id) + 1 FROM events) // 2)")
    rows = "SELECT id AS event_id, scope_key, state, root AS order_seq, sec AS created_at, provenance, expires_at FROM s1"
    out["upsert_changes"] = f"""WITH a AS (WITH {early} {rows}), b AS (WITH {_EV} {rows}) SELECT event_id, CASE WHEN a.state IS NULL THEN 'insert' ELSE 'update' END AS change FROM b LEFT JOIN a USING (event_id)
      WHERE a.state IS NULL OR (a.state, a.order_seq, a.created_at, a.provenance, coalesce(a.expires_at, 0)) <> (b.state, b.order_seq, b.created_at, b.provenance, coalesce(b.expires_at, 0))"""
    out["incremental_vs_replay"] = out["fold_parity"] = f"WITH {_EV}, rc AS ({q['row_counts']}) SELECT name, sum(n)::BIGINT AS rows, 0::BIGINT AS n FROM rc GROUP BY ALL"
    adding = _EV.replace("FROM ev WHERE what = 'statement')", "FROM ev WHERE what = 'statement' AND NOT (seq % 50 = 7 AND prev IS NOT NULL))").replace("r.what = 'event_retraction'", "false")
    out["incremental_reducer"] = f"WITH {adding}, rc AS ({q['row_counts']}) SELECT name, sum(n)::BIGINT AS rows, 0::BIGINT AS n FROM rc GROUP BY ALL"
    out["stream_projection"] = out["row_counts"]
    tables = {
        "statements": "SELECT id AS event_id, scope_key, state, root AS order_seq, sec AS created_at, provenance, expires_at FROM s1",
        "entities": "SELECT eid AS id, scope_key, name, norm AS normal_name, kind, NULL AS merged_into, origin_seq FROM en",
        "surface_forms": q["surface_forms"],
        "claims": q["claim_state"],
        "claim_support": "SELECT scope_key, claim_id, id AS event_id, 0 AS draft_index, live, expires_at FROM sup",
        "id_redirects": q["id_redirects"],
    }
    digests = []
    for name, rows in tables.items():
        cell = lambda f: f"coalesce('{f.dataType.typeName()[0]}' || length({f.name}::VARCHAR) || ':' || {f.name}::VARCHAR, 'n')"
        row = " || '|' || ".join([f"'{name}'", *map(cell, schema.TABLES[name])])
        sums = " || ':' || ".join(f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::UBIGINT)::VARCHAR" for i in range(5))
        digests.append(f"SELECT scope_key, '{name}' AS \"table\", count(*) AS n, sha256({sums}) AS digest FROM (SELECT scope_key, sha256({row}) AS h FROM ({rows})) GROUP BY scope_key")
    out["canonical_digest"] = f"WITH {_EV} " + " UNION ALL ".join(digests)
    users = "('user4', 'user5', 'user6', 'user7')"

    def level(k: int) -> str:
        seen = " AND ".join(f"(l.scope_key, l.to_id) NOT IN (SELECT scope_key, id FROM v{i})" for i in range(k))
        order = "v.disc * 1000 + l.rank"
        return f"""w{k} AS (SELECT l.scope_key, l.to_id AS id, min({order}) AS o, arg_min(l.claim_id, {order}) AS via, arg_min(v.path, {order}) AS path FROM lnk l JOIN v{k - 1} v ON v.scope_key = l.scope_key AND v.id = l.from_id WHERE l.rank <= {K.FANOUT} AND {seen} GROUP BY ALL),
          v{k} AS (SELECT w.scope_key, w.id, (SELECT max(disc) FROM v{k - 1} b WHERE b.scope_key = w.scope_key) + row_number() OVER (PARTITION BY w.scope_key ORDER BY o) AS disc, list_append(w.path, en.name) AS path, w.via, {k} AS lv FROM w{k} w JOIN en ON en.scope_key = w.scope_key AND en.eid = w.id)"""

    met = f"""WITH {_EV}, v0 AS (SELECT scope_key, eid AS id, 1::BIGINT AS disc, [name] AS path, NULL::VARCHAR AS via, 0 AS lv FROM en WHERE norm IN {users}), {level(1)}, {level(2)},
      best AS (SELECT v.scope_key, r.claim_id, arg_min(struct_pack(lv := v.lv, id := v.id, to_id := r.to_id, via := v.via, path := v.path), v.lv * 1000000000000 + v.disc * 1000 + r.ri) AS b FROM (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2) v JOIN rnk r ON r.scope_key = v.scope_key AND r.from_id = v.id WHERE r.ri <= {K.FANOUT} GROUP BY ALL),
      full_ AS (SELECT best.scope_key, claim_id, b.lv AS depth, b.id AS anchor_id, CASE WHEN en.name IS NOT NULL AND b.to_id <> b.id AND b.via IS DISTINCT FROM claim_id THEN list_append(b.path, en.name) ELSE b.path END AS path FROM best LEFT JOIN en ON en.scope_key = best.scope_key AND en.eid = b.to_id)
"""
    out["bfs_paths"] = met + "SELECT scope_key, claim_id, anchor_id, array_to_string(path, ' → ') AS path, (len(path) - 1)::BIGINT AS hops FROM full_"
    out["assembled_answer"] = met + f"""SELECT 'surface' AS entry, place, claim_id, text, score, depth, path FROM (SELECT *, row_number() OVER (ORDER BY score DESC, depth, strongest_rank DESC, support_count DESC, last_seen_at DESC, origin_seq, claim_id) AS place FROM (
      SELECT vc.*, f.depth::BIGINT AS depth, array_to_string(f.path, ' → ') AS path, a.name || ' ' || coalesce(relation_label, {_case("relation", K.PREDICATES)}) || ' ' || coalesce(b.name, literal) AS text,
      (CASE strongest_rank WHEN 3 THEN 6 WHEN 2 THEN 4 ELSE 1 END + least(support_count, 4) + CASE WHEN last_seen_at BETWEEN {NOW - K.RECENT} AND {NOW} THEN 2 ELSE 0 END - CASE WHEN con.claim_id IS NULL THEN 0 ELSE 3 END - 2 * f.depth)::BIGINT AS score
      FROM full_ f JOIN vc USING (scope_key, claim_id) LEFT JOIN con USING (scope_key, claim_id) JOIN en a ON a.scope_key = vc.scope_key AND a.eid = subject_id LEFT JOIN en b ON b.scope_key = vc.scope_key AND b.eid = object_id WHERE f.scope_key = 'u:1/p:events')) WHERE place <= {K.LIMIT}"""
    out["trigram_postings"] = f"WITH {_TX} SELECT scope_key, seq, len(list_distinct(g))::BIGINT AS trigrams, 3 * len(list_distinct(g))::BIGINT AS points FROM (SELECT scope_key, seq, list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2]) AS g FROM tx WHERE length(t) >= 3)"
    out["bm25_indexed"] = out["bm25_topk"]
    out["redirect_violations"] = """WITH e AS (SELECT event_id AS n FROM events), top AS (SELECT max(n) AS x FROM e), r AS (SELECT n, CASE WHEN n % 7 = 3 THEN n WHEN n % 7 = 5 THEN n + 10000000 ELSE n - 1 END AS t FROM e WHERE n % 5 <> 0 UNION ALL SELECT n, n - 2 FROM e WHERE n % 35 = 1)
      SELECT * FROM (SELECT 'SELF_REDIRECT' AS problem, count(DISTINCT n) AS n FROM r WHERE n = t UNION ALL SELECT 'DANGLING_REDIRECT', count(DISTINCT n) FROM r WHERE n <> t AND (t < 0 OR t > (SELECT x FROM top)) UNION ALL SELECT 'SEVERAL_REDIRECTS', count(*) FROM (SELECT n FROM r GROUP BY n HAVING count(*) > 1)) WHERE n > 0"""
    out["merge_alias_projection"] = f"""WITH {_EV[: _EV.index(',' + chr(10) + 'ev1')]},
      dr AS (SELECT scope_key, seq, 0 AS d, 'user ' || user_id AS s, relation, CASE WHEN relation <> 'describes' THEN 'item ' || k END AS o, CASE WHEN relation = 'describes' THEN 'tier ' || (seq % 3) END AS l, CASE WHEN relation = 'relates_to' THEN 'viewed ' || (seq % 4) END AS label, false AS born FROM ev0
        UNION ALL SELECT scope_key, seq, 1, 'item ' || k, 'relates_to', 'user ' || user_id, NULL, 'by ' || (seq % 5), false FROM ev0 WHERE relation <> 'describes' AND seq % 3 = 0),
      us AS (SELECT user_id, scope_key, min(seq) AS first, arg_min(k, seq) AS k FROM ev0 GROUP BY ALL), kept AS (SELECT * FROM us WHERE user_id % 8 < 4), mg AS (SELECT a.user_id, b.user_id AS gone FROM kept a JOIN us b ON b.user_id = a.user_id + 4),
      al AS (SELECT *, (SELECT max(seq) FROM ev0) + (SELECT count(*) FROM mg) + (SELECT count(*) FROM kept WHERE user_id % 3 = 0) + row_number() OVER (ORDER BY user_id) AS seq FROM kept WHERE user_id % 3 = 0),
      ds AS (SELECT * FROM dr UNION ALL SELECT scope_key, seq, 0, 'al user ' || user_id, 'uses', 'item ' || k, NULL, NULL, true FROM al),
      nm AS (SELECT 'user ' || gone AS name, 'user ' || user_id AS to_name FROM mg UNION ALL SELECT 'al user ' || user_id, 'user ' || user_id FROM al),
      ent AS (SELECT scope_key, name, min(code) AS code FROM (SELECT scope_key, s AS name, seq * 10 + 2 * d AS code FROM ds UNION ALL SELECT scope_key, o, seq * 10 + 2 * d + 1 FROM ds WHERE o IS NOT NULL) GROUP BY ALL),
      eid AS (SELECT scope_key, name, 'e' || (code // 10) || '.' || (code % 10) AS id FROM ent),
      pre AS (SELECT scope_key, s, relation, o, l, born, min(seq * 10 + d) AS code, max(seq * 10 + d) AS act, count(*) AS n, max(CASE WHEN label IS NOT NULL THEN seq * 10 + d END) AS said_at, arg_max(label, seq * 10 + d) FILTER (label IS NOT NULL) AS label FROM ds GROUP BY ALL),
      can AS (SELECT pre.*, coalesce(a.to_name, s) AS cs, coalesce(b.to_name, o) AS co FROM pre LEFT JOIN nm a ON a.name = s LEFT JOIN nm b ON b.name = o),
      post AS (SELECT scope_key, cs, relation, co, l, min(code) AS code, max(act) AS act, sum(n)::BIGINT AS n, arg_max(label, said_at) FILTER (said_at IS NOT NULL) AS label FROM can GROUP BY ALL),
      won AS (SELECT *, CASE WHEN relation = 'describes' AND act < max(act) OVER (PARTITION BY scope_key, cs, relation) THEN 'superseded' ELSE 'active' END AS state FROM post),
      gone AS (SELECT can.scope_key, can.cs, can.relation, can.co, can.l, can.code, 'superseded' AS state FROM can JOIN post ON post.scope_key = can.scope_key AND post.cs = can.cs AND post.relation = can.relation AND post.co IS NOT DISTINCT FROM can.co AND post.l IS NOT DISTINCT FROM can.l WHERE can.code <> post.code AND NOT can.born)
      SELECT r.scope_key, 'c' || (code // 10) || '.' || (code % 10) AS id, x.id AS subject_id, relation, y.id AS object_id, l AS object_value, state, code // 10 AS origin_seq, n AS support_count, label AS relation_label
      FROM (SELECT scope_key, cs, relation, co, l, code, state, CASE WHEN state = 'active' THEN n ELSE 0 END::BIGINT AS n, CASE WHEN state = 'active' THEN label END AS label FROM won UNION ALL SELECT *, 0, NULL FROM gone) r
      JOIN eid x ON x.scope_key = r.scope_key AND x.name = cs LEFT JOIN eid y ON y.scope_key = r.scope_key AND y.name = co"""
    decided = out["merge_alias_projection"]
    out["rollout_labels"] = f"SELECT scope_key, label, n, place FROM (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY n DESC, label) AS place FROM (SELECT scope_key, relation_label AS label, count(*) AS n FROM ({decided}) WHERE relation = 'relates_to' AND state = 'active' AND relation_label IS NOT NULL GROUP BY ALL)) WHERE place <= 3"
    out["reference_resolution"] = decided[: decided.index("pre AS (SELECT")] + """ids AS (SELECT DISTINCT e.scope_key, replace(e.name, ' ', '') AS norm, x.id FROM eid e LEFT JOIN nm ON nm.name = e.name JOIN eid x ON x.scope_key = e.scope_key AND x.name = coalesce(nm.to_name, e.name)),
      asked AS (SELECT 'u:' || s || '/p:events' AS scope_key, p || n AS norm FROM range(4) t(s), range(20) u(n), (VALUES ('user'), ('aluser'), ('item')) w(p))
      SELECT scope_key, norm AS name, CASE WHEN id IS NULL THEN 'not_found' ELSE 'resolved' END AS status, id AS entity_id FROM asked LEFT JOIN ids USING (scope_key, norm)"""
    return out


def oracle_sql() -> dict[str, str]:
    return _oracles()
