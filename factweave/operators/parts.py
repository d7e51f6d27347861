"""The fold over journals of any size: by parts of a scope that don't touch each other, with the rules of fold.Scope.

- Events that point at each other (reinterpretations, retractions of events) are pre-scanned together.
- Names that a merge or an alias links are resolved together, mention by mention. That gives each entity's way: when it
  became which other one. Claims have no say in it.
- Claims that have one identity once all entities have gone their ways are folded together, statement by statement;
  where a subject has one value only, all its values are.

Rows come to a task sorted by part and time and pass one by one. What it holds is a
part's names, or a part's claims, not its events. What can change nothing stays out
(_telling, and the claims that nothing joins or retracts), unless whole is asked for.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factweave import constants as K
from factweave.components import components
from factweave.functions import text
from factweave.operators import prescan, projection
from factweave.operators.fold import Claim, Entity, Scope, prescan as prescan_events
from factweave.operators.prescan import Refused
from factweave.operators.projection import Prepared, Projection
from factweave.scratch import compact

#: When something happens within a scope; a draft's claim (place CLAIM) comes after its names (places 0 and 1).
AT = ("order_seq", "seq", "draft_index", "place")
CLAIM = 2
#: Rows of what a part is come before what happens in it.
FIRST = -1
FLUSH_ROWS = 10_000
WAY = "array<struct<order_seq: long, seq: long, draft_index: int, place: int, to: string, reason: string>>"


def by_part(rows: DataFrame, keys: int, fn: Callable[[Iterator[tuple]], Iterable[tuple]], made: str, name: str) -> DataFrame:
    """The rows of each part (the first columns; the others sort them, from AT on) through fn, written. What fn refuses is refused here."""
    out = T.StructType.fromDDL(f"{made}, refused string")
    arrow = to_arrow_schema(out)
    blank = (None,) * (len(out) - 1)

    def batch(got: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        got: list[tuple] = []
        for _, part in itertools.groupby(each, key=lambda r: r[:keys]):
            try:
                got += [(*row, None) for row in fn(part)]
            except Refused as e:
                got.append((*blank, str(e)))
            if len(got) >= FLUSH_ROWS:
                yield batch(got)
                got = []
        if got:
            yield batch(got)

    at = rows.columns[:keys]
    sorted_rows = rows.repartition(*at).sortWithinPartitions(*at, *AT)
    found = compact(sorted_rows.mapInArrow(run, out), name)
    if bad := found.where("refused is not null").take(1):
        raise Refused(bad[0]["refused"])
    return found.drop("refused")


# --- events


def prescanned(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements with their state, order and lifetime; decisions that stand): chains of events that point at each other go through the fold's pre-scan."""
    root = prescan.roots(events).select("scope_key", F.col("id").alias("of"), "root_id")
    target = F.col("b.target.event_id")
    e = events.withColumn("of", F.coalesce(target, "id")).join(root, ["scope_key", "of"], "left").withColumn("chain", F.coalesce("root_id", "of"))
    zero = F.lit(0)
    rows = e.select("scope_key", "chain", F.col("seq").alias("order_seq"), "seq", zero.alias("draft_index"), zero.alias("place"), "id", "kind", "body", "created_at")

    def run(part: Iterator[tuple]) -> Iterator[tuple]:
        rows = [(r[0], dict(zip(("seq", "id", "kind", "body", "created_at"), (r[3], *r[6:])))) for r in part]
        statements, order = prescan_events([e for _, e in rows])
        for s in statements.values():
            yield rows[0][0], "statement", s.id, s.order, s.at, s.provenance, s.expires, s.state
        for _, _, i, kind, _ in order:
            if kind in ("merge", "alias"):
                yield rows[0][0], kind, i, None, None, None, None, None

    made = by_part(rows, 2, run, "scope_key string, kind string, id string, order_seq long, created_at long, provenance string, expires_at long, state string", "fold-events")
    bodies = events.where("kind = 'statement'").select("scope_key", "id", "seq", F.col("b.parsed").alias("parsed"))
    stated = made.where("kind = 'statement'").drop("kind").join(bodies, ["scope_key", "id"])
    return stated, events.join(made.where("kind != 'statement'").select("scope_key", "id"), ["scope_key", "id"], "left_semi")


# --- names


def _part_key(name: str = "normal_name"):
    return F.concat_ws("\x1f", "scope_key", name)


def _linked(p: Prepared, decided: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, part) of names that a merge links, or an alias that is another entity's name."""
    named = p.mentioned.where("aliases is not null and state = 'live'").select("scope_key", F.col("normal_name").alias("of"), F.explode("aliases").alias("a")).select("scope_key", "of", text.normalize_name("a").alias("normal_name"))
    of = lambda c: targets.select("scope_key", F.col("ref").alias(c), F.col("normal_name").alias(f"{c}_name"))
    called = decided.where("kind = 'alias'").select("scope_key", F.col("b.entity_id").alias("x"), text.normalize_name("b.surface").alias("normal_name")).join(of("x"), ["scope_key", "x"]).select("scope_key", F.col("x_name").alias("of"), "normal_name")
    merged = decided.where("kind = 'merge'").select("scope_key", F.col("b.keep").alias("x"), F.col("b.absorb").alias("y")).join(of("x"), ["scope_key", "x"]).join(of("y"), ["scope_key", "y"]).select("scope_key", F.col("x_name").alias("of"), F.col("y_name").alias("normal_name"))
    names = p.mentioned.select("scope_key", "normal_name").distinct()
    aliased = named.unionByName(called).where("normal_name != of").distinct().join(names, ["scope_key", "normal_name"], "left_semi")
    edges = aliased.unionByName(merged).select(_part_key("of").alias("a"), _part_key().alias("b"))
    return components(edges).select(F.col("id").alias("key"), F.col("root").alias("part"))


def _hops(scope: Scope, entity: str) -> int:
    n = 0
    while entity in scope.moved:
        entity, n = scope.moved[entity][0], n + 1
    return n


def fold_names(part: Iterator[tuple]) -> Iterator[tuple]:
    """A part's names, mention by mention and decision by decision: (scope_key, what, id or name, entity, origin or kind, way) of its entities and surface forms."""
    scope, several, kinds, said = Scope(""), set(), {}, []

    def flush() -> None:
        for at, place, normal, entity, origin, kind, aliases in said:
            scope.say(normal, scope.now(entity), origin)
            for alias in aliases or ():
                scope.say(text.normal_name(alias), scope.now(entity), "agent_supplied")
            if kind is not None:
                kinds.setdefault(scope.now(entity), (*at, place, kind))
        said.clear()

    now = None
    for key, _, order, seq, draft, place, what, ref, first, normal, kind, aliases, ref2, first2, n in part:
        scope.key = key
        if order == FIRST:
            scope.first[normal], scope.entities[ref] = ref, Entity(ref, normal, normal, seq)
            if n > 1:
                several.add(ref)
            continue
        if said and now != (order, seq, draft):
            flush()
        now = (order, seq, draft)
        scope.at = (order, seq, draft, place)
        # only first mentions are entities; another one leads to its first for as long as it is looked at
        others = {r: f for r, f in ((ref, first), (ref2, first2)) if r is not None and f is not None and r != f}
        scope.moved.update((r, (f, "deduplicated")) for r, f in others.items())
        if what == "mention":
            said.append((now, place, normal, *scope.resolve(ref, normal), kind, aliases))
        elif what == "merge":
            scope.merge(seq, {"keep": ref, "absorb": ref2})
        else:
            scope.alias(seq, {"entity_id": ref, "surface": normal})
        for r in others:
            del scope.moved[r]
    flush()
    best: dict[str, tuple] = {}
    for e, k in kinds.items():
        best[scope.now(e)] = min(k, best.get(scope.now(e), k))
    for e in scope.entities:
        to = scope.now(e)
        if e in several and _hops(scope, e) >= K.REDIRECT_HOPS:  # its other mentions are one hop further away
            raise Refused("REDIRECT_TOO_LONG")
        way, at = [], e
        while at in scope.moved:
            to_, reason = scope.moved[at]
            way.append((*scope.when[at], to_, reason))
            at = to_
        yield scope.key, "entity", e, to if way else None, best[e][-1] if e in best else None, [dict(zip((*AT, "to", "reason"), w)) for w in way] or None
    for normal, found in scope.surfaces.items():
        for e, origin in found.items():
            yield scope.key, "surface", normal, e, origin, None


def _telling(rows: DataFrame) -> DataFrame:
    """The mentions that can change a part's names or be refused, and all else.

    Only a name's first live mention moves its entity: from then on its surface form leads to where its entity is. Later
    ones tell something by aliases, as the one that the entity is named by, as the first to give a kind, or by being
    ambiguous, which needs a decision, an alias or a first mention in the part since the name's last one.
    """
    mention, at = F.col("what") == "mention", F.struct(*AT)
    turn = ~mention | (F.col("what") != "entity") & ((F.col("at") == at) | F.col("aliases").isNotNull())
    tells = ~mention | (F.col("at") == at) | (F.col("kind_at") == at) | F.col("aliases").isNotNull() | (F.col("ref") == F.col("first"))
    linked = rows.where("linked").withColumn("turns", F.sum(F.coalesce(turn, F.lit(False)).cast("int")).over(Window.partitionBy("scope_key", "part").orderBy(*AT)))
    again = F.row_number().over(Window.partitionBy("scope_key", "part", "what", "normal_name", "turns").orderBy(*AT))
    linked = linked.withColumn("nth", again).where(F.coalesce(tells, F.lit(False)) | (F.col("nth") == 1)).drop("turns", "nth")
    return rows.where(~F.col("linked") & F.coalesce(tells, F.lit(False))).unionByName(linked)


def names(p: Prepared, found: DataFrame, decided: DataFrame, whole: bool) -> DataFrame:
    """What fold_names makes of all names."""
    decided = compact(decided.select("scope_key", "seq", "kind", "b"), "decided")
    refs = decided.select("scope_key", F.explode(F.array("b.keep", "b.absorb", "b.entity_id")).alias("ref")).where("ref is not null").distinct()
    live, at = F.col("state") == "live", F.struct(*AT)
    each = p.mentioned.groupBy("scope_key", "normal_name").agg(F.count("*").alias("n"), F.min(F.when(live, at)).alias("at"), F.min(F.when(live & F.col("kind").isNotNull(), at)).alias("kind_at"))
    found = compact(found.join(each, ["scope_key", "normal_name"]), "named")
    first = found.select("scope_key", "normal_name", F.col("id").alias("first"), "at", "kind_at")
    targets = compact(p.mentioned.select("scope_key", "ref", "normal_name").join(refs, ["scope_key", "ref"], "left_semi").join(first.drop("at", "kind_at"), ["scope_key", "normal_name"]), "targets")
    linked = _linked(p, decided, targets)
    text_, array_, zero = F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(0)
    entity = found.select(
        "scope_key", _part_key().alias("key"), F.lit(FIRST).cast("long").alias("order_seq"), F.col("origin_seq").alias("seq"), zero.alias("draft_index"), zero.alias("place"), F.lit("entity").alias("what"),
        F.col("id").alias("ref"), F.col("id").alias("first"), "normal_name", text_.alias("kind"), array_.alias("aliases"), text_.alias("ref2"), text_.alias("first2"), "n", "at", "kind_at",
    )
    one = F.lit(1).cast("long").alias("n")
    mention = p.mentioned.where("state = 'live'").join(first, ["scope_key", "normal_name"]).select(
        "scope_key", _part_key().alias("key"), "order_seq", "seq", "draft_index", "place", F.lit("mention").alias("what"), "ref", "first", "normal_name", "kind", "aliases", text_.alias("ref2"), text_.alias("first2"), one, "at", "kind_at",
    )
    of = lambda ref, first, name: targets.select("scope_key", F.col("ref").alias(ref), F.col("first").alias(first), F.col("normal_name").alias(name))
    d = decided.withColumn("ref", F.coalesce("b.keep", "b.entity_id")).withColumn("ref2", F.col("b.absorb")).join(of("ref", "first", "name"), ["scope_key", "ref"], "left").join(of("ref2", "first2", "name2"), ["scope_key", "ref2"], "left")
    decision = d.withColumn("name", F.coalesce("name", "name2", F.lit(""))).select(
        "scope_key", _part_key("name").alias("key"), F.col("seq").alias("order_seq"), "seq", zero.alias("draft_index"), zero.alias("place"), F.col("kind").alias("what"),
        "ref", "first", text.normalize_name("b.surface").alias("normal_name"), text_.alias("kind"), array_.alias("aliases"), "ref2", "first2", one, F.lit(None).cast(found.schema["at"].dataType).alias("at"), F.lit(None).cast(found.schema["at"].dataType).alias("kind_at"),
    )
    rows = entity.unionByName(mention).unionByName(decision).join(linked, "key", "left").withColumn("linked", F.col("part").isNotNull()).withColumn("part", F.coalesce("part", "key"))
    rows = (rows if whole else _telling(rows)).drop("key", "linked", "at", "kind_at")
    rows = rows.select("scope_key", "part", *(c for c in rows.columns if c not in ("scope_key", "part")))
    return by_part(rows, 2, fold_names, f"scope_key string, what string, name string, entity string, value string, way {WAY}", "fold-names")


# --- claims


@dataclass
class Anchor:
    """Stands for all supports of a claim occurrence's identity: where they are, and until when retractions took them."""

    claim: str
    gone_at: int | None = None


def fold_claims(part: Iterator[tuple]) -> Iterator[tuple]:
    """Claims that become one or are values of one subject: (scope_key, id, to, reason, gone_at, state, subject_id, relation, object_id, object_value, origin_seq, created_at), state null for claims that are not rows."""
    scope, anchors, several, moves, told, seen, now, done = Scope(""), {}, set(), {}, None, set(), None, 0

    def until(at: tuple | None) -> None:
        nonlocal done
        while done < len(told) and (at is None or told[done][0] < at):
            when, old, new, reason = told[done]
            scope.at, done = when, done + 1
            scope.move_entity(old, new, reason)

    for row in part:
        order, seq, draft, place, what, i = row[5:11]
        if order == FIRST:
            scope.key = row[0]
            _, _, subject, relation, object_, literal, s_way, o_way, created_at, n = row[9:19]
            c = Claim(i, subject, relation, object_, literal, created_at)
            anchors[i] = (subject, object_, a := Anchor(i), c, seq)
            c.supports.append(a)
            scope.claims[i] = c
            scope.same[(subject, relation, object_, literal)] = i
            scope.place(c)
            if n > 1:
                several.add(i)
            for old, way in ((subject, s_way), (object_, o_way)):
                for step in way or ():
                    moves[old] = ((step["order_seq"], step["seq"], step["draft_index"], step["place"]), old, step["to"], step["reason"])
                    old = step["to"]
            continue
        if told is None:
            told = sorted(moves.values())
        until((order, seq, draft, place))
        subject, object_, _, c, _ = anchors[i]
        if what == "retract":
            found = scope.claims[scope.now(i)]
            for a in found.supports:
                a.gone_at = seq
            found.state = "retracted"
            continue
        if now != (order, seq):
            now = (order, seq)
            seen.clear()
        scope.activate(Claim(i, scope.now(subject), c.relation, object_ and scope.now(object_), c.literal, 0), (order, seq, draft), seen)
    if told is None:
        told = sorted(moves.values())
    until(None)
    for i, (_, _, a, c, seq) in anchors.items():
        to = scope.now(i)
        if i in several and _hops(scope, i) >= K.REDIRECT_HOPS:
            raise Refused("REDIRECT_TOO_LONG")
        state = c.state if i in scope.claims or i in scope.gone else None
        yield scope.key, i, to, scope.moved[i][1] if i in scope.moved else None, a.gone_at, state, scope.now(c.subject), c.relation, c.object and scope.now(c.object), c.literal, seq, c.at


def claims(p: Prepared, resolved: DataFrame, ways: DataFrame, whole: bool) -> DataFrame:
    """What fold_claims makes of all claims; unless whole, one that is alone in its part, with no other value, retraction or statement of it twice, is what it would be there. resolved: drafts with their claims before any decision; ways: (scope_key, id, to, way) of moved entities."""
    blank = F.lit("")
    to = lambda c: ways.select("scope_key", F.col("id").alias(f"{c}_id"), F.col("to").alias(f"{c}_to"))
    way = lambda c: ways.select("scope_key", F.col("id").alias(f"{c}_id"), F.col("way").alias(f"{c}_way"))
    single = F.col("relation") == K.SINGLE
    keyed = resolved.select("scope_key", "claim_id", "claim_ref", "seq", "order_seq", "draft_index", "state", "created_at", "subject_id", "relation", "object_id", "literal").join(to("subject"), ["scope_key", "subject_id"], "left").join(to("object"), ["scope_key", "object_id"], "left")
    keyed = keyed.withColumn("s", F.coalesce("subject_to", "subject_id")).withColumn("r", F.col("relation")).withColumn("o", F.when(single, blank).otherwise(F.coalesce("object_to", "object_id", blank))).withColumn("l", F.when(single, blank).otherwise(F.coalesce("literal", blank)))
    keyed = compact(keyed.drop("subject_to", "object_to"), "fold-keyed")
    key, text_, zero, way_ = ["scope_key", "s", "r", "o", "l"], F.lit(None).cast("string"), F.lit(0), F.lit(None).cast(WAY)
    r = p.events.where("kind = 'retraction' and b.target.claim_id is not null").select("scope_key", F.col("seq").alias("r_seq"), F.col("b.target.claim_id").alias("claim_ref"))
    gone = compact(r.join(keyed.select(*key, "claim_ref", "claim_id"), ["scope_key", "claim_ref"]), "fold-gone")
    own = keyed.groupBy(*key, "claim_id").agg(F.max((F.col("state") == "live").cast("int")).alias("live"), *(F.first(c).alias(c) for c in ("subject_id", "relation", "object_id", "literal")), F.min(F.struct("seq", "draft_index", "created_at")).alias("a"), F.count("*").alias("n"))
    made = "scope_key string, id string, to string, reason string, gone_at long, state string, subject_id string, relation string, object_id string, object_value string, origin_seq long, created_at long"
    alone = None
    if not whole:
        own = compact(own, "fold-own")
        twice = keyed.where((F.col("state") == "live") & (F.col("r") != K.SINGLE)).groupBy(*key, "seq").agg(F.count("*").alias("n")).where("n > 1")
        met = own.where(single).select(*key).unionByName(own.where(~single).groupBy(*key).agg(F.count("*").alias("claims")).where("claims > 1").select(*key))
        met = compact(met.unionByName(twice.select(*key)).unionByName(gone.select(*key)).distinct(), "fold-met")
        alone = own.join(met, key, "left_anti").select(
            "scope_key", F.col("claim_id").alias("id"), F.col("claim_id").alias("to"), text_.alias("reason"), F.lit(None).cast("long").alias("gone_at"), F.when(F.col("live") == 1, "active").otherwise("retracted").alias("state"),
            F.col("s").alias("subject_id"), "relation", F.nullif("o", blank).alias("object_id"), F.col("literal").alias("object_value"), F.col("a.seq").alias("origin_seq"), F.col("a.created_at").alias("created_at"),
        )
        own, keyed, gone = (t.join(met, key, "left_semi") for t in (own, keyed, gone))
    own = own.join(way("subject"), ["scope_key", "subject_id"], "left").join(way("object"), ["scope_key", "object_id"], "left")
    anchor = own.select(*key, F.lit(FIRST).cast("long").alias("order_seq"), F.col("a.seq").alias("seq"), F.col("a.draft_index").alias("draft_index"), zero.alias("place"), F.lit("claim").alias("what"), "claim_id", "subject_id", "relation", "object_id", "literal", "subject_way", "object_way", F.col("a.created_at").alias("created_at"), "n")
    empty = [text_.alias("subject_id"), text_.alias("relation"), text_.alias("object_id"), text_.alias("literal"), way_.alias("subject_way"), way_.alias("object_way"), F.lit(None).cast("long").alias("created_at"), F.lit(0).cast("long").alias("n")]
    act = keyed.where("state = 'live'").select(*key, "order_seq", "seq", "draft_index", F.lit(CLAIM).alias("place"), F.lit("state").alias("what"), "claim_id", *empty)
    gone = gone.select(*key, F.col("r_seq").alias("order_seq"), F.col("r_seq").alias("seq"), zero.alias("draft_index"), F.lit(CLAIM).alias("place"), F.lit("retract").alias("what"), "claim_id", *empty)
    folded = by_part(anchor.unionByName(act).unionByName(gone), 5, fold_claims, made, "fold-claims")
    return folded if alone is None else folded.unionByName(alone)


# --- all


def project(journal: DataFrame) -> Projection:
    """The projection of every scope of a journal by the fold."""
    events = journal if "b" in journal.columns else compact(prescan.parsed(journal), "events")
    stated, decided = prescanned(events)
    stated = compact(stated, "statements")
    drafts = compact(prescan.occurrences(stated), "drafts")
    return project_prepared(Prepared(events, stated, drafts, compact(projection.mentions(drafts), "mentions")), decided, whole=True)


def project_prepared(p: Prepared, decided: DataFrame | None = None, whole: bool = False) -> Projection:
    """As project(), after the steps before projection. decided: the decisions that stand, where they are known; whole: all mentions and claims go through the fold."""
    if bad := projection.unusable(p).take(1):
        raise Refused(bad[0]["problem"])
    found = compact(projection.entities_of(p.mentioned), "entities")
    named = names(p, found, prescan.decisions(p.events) if decided is None else decided, whole)
    entity = named.where("what = 'entity'").select("scope_key", F.col("name").alias("id"), F.col("entity").alias("to"), F.col("value").alias("kind"), "way")
    ways = compact(entity.where("to is not null").drop("kind"), "ways")
    resolved = compact(projection.resolved_claims(p.drafts, found), "claims")
    folded = claims(p, resolved, ways, whole)
    led = folded.select("scope_key", F.col("id").alias("claim_id"), "to", "reason", "gone_at")
    each = compact(resolved.select("scope_key", "claim_id", "claim_ref", "id", "draft_index", "state", "order_seq", "created_at", "expires_at").join(led, ["scope_key", "claim_id"]), "supports")
    live = (F.col("state") == "live") & (F.col("order_seq") > F.coalesce("gone_at", F.lit(0)))
    support = compact(each.groupBy("scope_key", F.col("to").alias("claim_id"), F.col("id").alias("event_id")).agg(F.min("draft_index").alias("draft_index"), F.max(live.cast("int")).alias("live"), F.first("expires_at").alias("expires_at"), F.first("created_at").alias("created_at")), "support")
    seen = support.where("live = 1").groupBy("scope_key", F.col("claim_id").alias("id")).agg(F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    rows = folded.where("state is not null").join(seen, ["scope_key", "id"], "left").withColumn("state", F.when((F.col("state") == "active") & F.col("first_seen").isNull(), "retracted").otherwise(F.col("state")))
    moved = each.where("claim_ref != to").select("scope_key", F.col("claim_ref").alias("old_id"), F.col("to").alias("new_id"), F.lit("claim").alias("kind"), F.when(F.col("claim_ref") == F.col("claim_id"), F.col("reason")).otherwise("deduplicated").alias("reason"))
    ends = found.join(entity, ["scope_key", "id"])
    mention = p.mentioned.select("scope_key", "ref", "normal_name").join(ends.select("scope_key", "normal_name", "id", F.coalesce("to", "id").alias("new_id"), F.get("way", 0)["reason"].alias("reason")), ["scope_key", "normal_name"])
    went = mention.where("ref != new_id").select("scope_key", F.col("ref").alias("old_id"), "new_id", F.lit("entity").alias("kind"), F.when(F.col("ref") == F.col("id"), F.col("reason")).otherwise("deduplicated").alias("reason"))
    return Projection(
        statements=p.stated.select(F.col("id").alias("event_id"), "scope_key", "state", "order_seq", "created_at", "provenance", "expires_at"),
        entities=ends.select("id", "scope_key", "name", "normal_name", "kind", F.col("to").alias("merged_into"), "origin_seq"),
        surface_forms=named.where("what = 'surface'").select("scope_key", F.col("name").alias("surface_norm"), F.col("entity").alias("entity_id"), F.col("value").alias("origin")),
        claims=rows.select("id", "scope_key", "subject_id", "relation", "object_id", "object_value", "state", "origin_seq", F.coalesce("first_seen", "created_at").alias("first_seen_at"), F.coalesce("last_seen", "created_at").alias("last_seen_at")),
        claim_support=support.select("scope_key", "claim_id", "event_id", "draft_index", "live", "expires_at"),
        id_redirects=moved.unionByName(went),
    )
