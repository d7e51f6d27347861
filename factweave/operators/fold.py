"""The general projector: a plain fold over a scope's effective events.

It handles what the set-based way can't: merges, aliases and the resolution of
names that depends on them. `reduce_scope` folds one scope in memory and says what
is right; `factweave.operators.parts` folds journals of any size, by parts of a
scope that don't touch each other, with the same rules.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from factweave import constants as K
from factweave.functions import text
from factweave.functions.identifiers import key as id_key
from factweave.operators.prescan import Refused


@dataclass
class Stated:
    """A statement with its root's order, time, provenance and lifetime."""

    id: str
    seq: int
    order: int
    at: int
    provenance: str
    expires: int | None
    drafts: list[dict]
    state: str = "live"


@dataclass
class Claim:
    id: str
    subject: str
    relation: str
    object: str | None
    literal: str | None
    at: int
    state: str = "retracted"
    act: tuple | None = None
    supports: list = field(default_factory=list)


@dataclass
class Entity:
    id: str
    name: str
    normal: str
    seq: int


@dataclass
class Support:
    claim: str
    event: Stated
    draft: int
    live: int = 0


@dataclass
class Scope:
    """Everything a scope's events lead to."""

    key: str
    statements: dict[str, Stated] = field(default_factory=dict)
    entities: dict[str, Entity] = field(default_factory=dict)
    claims: dict[str, Claim] = field(default_factory=dict)
    supports: list[Support] = field(default_factory=list)
    surfaces: dict[str, dict[str, str]] = field(default_factory=dict)
    kinds: list[tuple] = field(default_factory=list)
    moved: dict[str, tuple[str, str]] = field(default_factory=dict)
    gone: dict[str, Claim] = field(default_factory=dict)
    same: dict[tuple, str] = field(default_factory=dict)  # claims by identity
    slot: dict[str, str] = field(default_factory=dict)  # the active value of each subject
    touching: dict[str, set[str]] = field(default_factory=dict)  # claims by the entities at their ends
    named: dict[str, set[str]] = field(default_factory=dict)  # normal names by entity
    first: dict[str, str] = field(default_factory=dict)  # entities by normal name, before any decision
    at: tuple = ()  # of the event that is applied
    when: dict[str, tuple] = field(default_factory=dict)  # at, by moved entity

    # --- redirects

    def now(self, identifier: str) -> str:
        """Where an id leads."""
        for _ in range(K.REDIRECT_HOPS + 1):
            if identifier not in self.moved:
                return identifier
            identifier = self.moved[identifier][0]
        raise Refused("REDIRECT_TOO_LONG")

    def move_entity(self, old: str, new: str, reason: str) -> None:
        """An entity becomes another: its surfaces go along, claims that now are one are joined. Only what touches the entity is looked at."""
        self.moved[old], self.when[old] = (new, reason), self.at
        for normal in self.named.pop(old, ()):
            self.surface_of(normal, new, self.surfaces[normal].pop(old))
        self.join_claims(reason, self.touching.get(old, set()))
        self.settle(new)

    def surface_of(self, normal: str, entity: str, origin: str) -> None:
        found = self.surfaces.setdefault(normal, {})
        self.named.setdefault(entity, set()).add(normal)
        if K.ORIGIN_RANK[origin] > K.ORIGIN_RANK.get(found.get(entity, ""), 0):
            found[entity] = origin

    # --- claims

    def identity(self, c: Claim) -> tuple:
        return self.now(c.subject), c.relation, None if c.object is None else self.now(c.object), c.literal

    def place(self, c: Claim) -> None:
        for e in (c.subject, c.object):
            if e is not None:
                self.touching.setdefault(e, set()).add(c.id)

    def displace(self, c: Claim) -> None:
        for e in (c.subject, c.object):
            if e is not None:
                self.touching.get(e, set()).discard(c.id)

    def restate(self, c: Claim, subject: str, object_: str | None) -> None:
        """A claim under other ends; who has its identity is for join_claims to settle."""
        for same in [(c.subject, c.relation, c.object, c.literal), self.identity(c)]:
            if self.same.get(same) == c.id:
                del self.same[same]
        self.displace(c)
        c.subject, c.object = subject, object_
        self.place(c)

    def join_claims(self, reason: str, changed: set[str]) -> None:
        """Claims whose ends have changed meet others of their identity: the first id stays, in the strongest state, activated as the latest of that state."""
        same: dict[tuple, list[Claim]] = {}
        for i in sorted(changed, key=id_key):
            c = self.claims[i]
            self.restate(c, self.now(c.subject), None if c.object is None else self.now(c.object))
            same.setdefault(self.identity(c), []).append(c)
        for key, rows in same.items():
            if (held := self.same.get(key)) is not None and all(held != c.id for c in rows):
                rows.append(self.claims[held])
            if len(rows) == 1:
                self.same[key] = rows[0].id
                continue
            rows.sort(key=lambda c: id_key(c.id))
            state = next(s for s in ("active", "superseded", "retracted") if any(c.state == s for c in rows))
            act = max((c.act for c in rows if c.state == state and c.act), default=None)
            first, *others = rows
            for c in others:
                self.moved[c.id] = (first.id, reason)
                c.state = "superseded"
                self.displace(c)
                if self.slot.get(c.subject) == c.id:  # an object's move may join the active value with another
                    self.slot[c.subject] = first.id
                del self.claims[c.id]
                if reason == "merge":
                    self.gone[c.id] = c
                for s in c.supports:
                    s.claim = first.id
                first.supports += c.supports
                c.supports = []
            first.state, first.act = state, act
            self.same[key] = first.id

    def settle(self, subject: str) -> None:
        """Of a subject's active values the one activated last stays."""
        rows = [c for c in map(self.claims.__getitem__, self.touching.get(subject, ())) if c.subject == subject and c.state == "active" and c.relation == K.SINGLE]
        self.slot.pop(subject, None)
        if rows:
            last = max(rows, key=lambda c: c.act)
            for c in rows:
                if c is not last:
                    c.state = "superseded"
            self.slot[subject] = last.id

    # --- anchors: every occurrence has an entity and a claim, dead or not

    def anchor(self) -> None:
        first, claims = self.first, self.same
        for s in sorted(self.statements.values(), key=lambda s: s.seq):
            position = 0
            for i, d in enumerate(s.drafts):
                refs = []
                for part in ("subject", "object"):
                    if d.get(part) is None:
                        refs.append(None)
                        continue
                    ref, normal = f"e{s.seq}.{position}", text.normal_name(d[part])
                    if normal is None:
                        raise Refused("EMPTY_NAME")
                    position += 1
                    if normal in first:
                        self.moved[ref] = (first[normal], "deduplicated")
                    else:
                        first[normal] = ref
                        self.entities[ref] = Entity(ref, d[part], normal, s.seq)
                    refs.append(ref)
                d["refs"] = refs
                c = Claim(f"c{s.seq}.{i}", self.now(refs[0]), d["relation"], refs[1] and self.now(refs[1]), text.normal_literal(d.get("object_value")), s.at)
                same = self.identity(c)
                if same in claims:
                    self.moved[c.id] = (claims[same], "deduplicated")
                else:
                    claims[same] = c.id
                    self.claims[c.id] = c
                    self.place(c)
                d["support"] = Support(self.now(c.id), s, i)
                self.supports.append(d["support"])
                self.claims[d["support"].claim].supports.append(d["support"])

    # --- events

    def resolve(self, ref: str, normal: str) -> tuple[str, str]:
        """(entity, origin of the name) of an occurrence of a normal name when it is stated."""
        own = ref in self.entities and ref not in self.moved
        current = self.now(ref)
        hits = sorted({self.now(e) for e in self.surfaces.get(normal, {})}, key=id_key)
        if len(hits) > 1:
            hits = [e for e in hits if self.entities[e].normal == normal]
            if len(hits) != 1:
                raise Refused("AMBIGUOUS_ENTITY")
        chosen = hits[0] if hits else self.now(self.first[normal])
        if chosen != current:
            self.move_entity(current, chosen, "deduplicated")
        return chosen, "name" if own and chosen == ref else "agent_supplied"

    def say(self, normal: str | None, entity: str, origin: str) -> None:
        if normal:
            self.surface_of(normal, entity, origin)

    def activate(self, want: Claim, act: tuple, seen: set[tuple]) -> Claim:
        """The claim that a draft's own one now is becomes active; seen: what its statement has stated before."""
        same = self.identity(want)
        if same in seen:
            raise Refused("DUPLICATE_STATEMENT_CLAIM")
        seen.add(same)
        found = self.claims[self.same[same]] if same in self.same else None
        if found is None:  # the anchor's own claim, under the name that it has now
            found = self.claims[self.now(want.id)]
            self.restate(found, want.subject, want.object)
            self.same[same] = found.id
        elif self.now(want.id) != found.id:
            own = self.claims[self.now(want.id)]
            self.restate(own, want.subject, want.object)
            self.join_claims("deduplicated", {own.id})
            self.settle(want.subject)
            found = self.claims[self.now(found.id)]
        if found.relation == K.SINGLE:
            rival = self.claims.get(self.slot.get(self.now(found.subject), ""))
            if rival is not None and rival is not found and rival.state == "active":
                rival.state = "superseded"
            self.slot[self.now(found.subject)] = found.id
        found.state, found.act = "active", act
        return found

    def state(self, s: Stated) -> None:
        seen: set[tuple] = set()
        for i, d in enumerate(s.drafts):
            ends: list[str | None] = [None, None]
            for k, part in enumerate(("subject", "object")):
                if d["refs"][k] is not None:
                    ends[k], origin = self.resolve(d["refs"][k], text.normal_name(d[part]))
                    d[part + "_origin"] = origin
            for k, part in enumerate(("subject", "object")):
                if ends[k] is None:
                    continue
                self.say(text.normal_name(d[part]), self.now(ends[k]), d[part + "_origin"])
                for alias in d.get(part + "_aliases") or []:
                    self.say(text.normal_name(alias), self.now(ends[k]), "agent_supplied")
                if kind := text.normal_kind(d.get(part + "_kind")):
                    self.kinds.append((s.order, s.seq, i, k, self.now(ends[k]), kind))
            want = Claim(f"c{s.seq}.{i}", self.now(ends[0]), d["relation"], ends[1] and self.now(ends[1]), text.normal_literal(d.get("object_value")), s.at)
            found = self.activate(want, (s.order, s.seq, i), seen)
            support = d["support"]
            if support.claim != found.id:
                self.claims[support.claim].supports.remove(support)
                found.supports.append(support)
            support.claim, support.live = found.id, 1

    def earlier(self, identifier: str, seq: int, problem: str) -> None:
        if id_key(identifier) >= (seq, 0):
            raise Refused(problem)

    def merge(self, seq: int, body: dict) -> None:
        keep, absorb = body["keep"], body["absorb"]
        for e in (keep, absorb):
            self.earlier(e, seq, "DECISION_TARGET_NOT_PAST")
            if self.now(e) not in self.entities:
                raise Refused("MERGE_TARGET_NOT_FOUND")
        a, b = self.now(keep), self.now(absorb)
        if a == b:
            at = keep
            while at != absorb and at in self.moved:
                at = self.moved[at][0]
            if at == absorb:
                raise Refused("MERGE_CYCLE")
            return
        self.move_entity(b, a, "merge")

    def alias(self, seq: int, body: dict) -> None:
        self.earlier(body["entity_id"], seq, "DECISION_TARGET_NOT_PAST")
        if self.now(body["entity_id"]) not in self.entities:
            raise Refused("ALIAS_TARGET_NOT_FOUND")
        self.say(text.normal_name(body["surface"]), self.now(body["entity_id"]), "confirmed")

    def retract(self, seq: int, claim: str) -> None:
        self.earlier(claim, seq, "CLAIM_RETRACTION_TARGET_NOT_PAST")
        found = self.claims.get(self.now(claim))
        if found is None:
            raise Refused("CLAIM_RETRACTION_TARGET_NOT_FOUND")
        for s in found.supports:
            if s.event.order < seq:
                s.live = 0
        found.state = "retracted"

    # --- rows

    def rows(self) -> dict[str, list[dict]]:
        seen: dict[str, list[int]] = {}
        merged: dict[tuple[str, str], dict] = {}
        for s in self.supports:
            if s.live:
                seen.setdefault(s.claim, []).append(s.event.at)
            row = merged.setdefault((s.claim, s.event.id), {"scope_key": self.key, "claim_id": s.claim, "event_id": s.event.id, "draft_index": s.draft, "live": 0, "expires_at": s.event.expires})
            row["draft_index"], row["live"] = min(row["draft_index"], s.draft), max(row["live"], s.live)
        kinds: dict[str, str] = {}
        for *_, entity, kind in sorted(self.kinds):
            kinds.setdefault(self.now(entity), kind)
        claims = []
        for c in [*self.claims.values(), *self.gone.values()]:
            times = seen.get(c.id)
            if c.state == "active" and not times:
                c.state = "retracted"
            claims.append({"id": c.id, "scope_key": self.key, "subject_id": self.now(c.subject), "relation": c.relation, "object_id": c.object and self.now(c.object), "object_value": c.literal, "state": c.state, "origin_seq": id_key(c.id)[0], "first_seen_at": min(times) if times else c.at, "last_seen_at": max(times) if times else c.at})
        return {
            "statements": [{"event_id": s.id, "scope_key": self.key, "state": s.state, "order_seq": s.order, "created_at": s.at, "provenance": s.provenance, "expires_at": s.expires} for s in self.statements.values()],
            "entities": [{"id": e.id, "scope_key": self.key, "name": e.name, "normal_name": e.normal, "kind": kinds.get(e.id), "merged_into": self.now(e.id) if e.id in self.moved else None, "origin_seq": e.seq} for e in self.entities.values()],
            "surface_forms": [{"scope_key": self.key, "surface_norm": n, "entity_id": e, "origin": o} for n, found in self.surfaces.items() for e, o in found.items()],
            "claims": claims,
            "claim_support": list(merged.values()),
            "id_redirects": [{"scope_key": self.key, "old_id": old, "new_id": self.now(old), "kind": "entity" if old[0] == "e" else "claim", "reason": reason} for old, (_, reason) in self.moved.items()],
        }


def prescan(events: list[dict]) -> tuple[dict[str, Stated], list[tuple]]:
    """Statements by id, and the effective stream as (order, seq, id, kind, body)."""
    by, root, order = {}, {}, []
    for e in sorted(events, key=lambda e: e["seq"]):
        if e["id"] in by:
            raise Refused("DUPLICATE_EVENT_ID")
        by[e["id"]] = e = {**e, "b": json.loads(e["body"])}
        if e["kind"] == "statement":
            up = e["b"].get("supersedes")
            if up is not None:
                if up not in root:
                    raise Refused("SUPERSEDES_TARGET_NOT_FOUND")
                if any(e["b"][k] != by[up]["b"][k] for k in ("raw_text", "provenance", "ttl")):
                    raise Refused("SUPERSEDES_CONTENT_MISMATCH")
            root[e["id"]] = root[up] if up else e["id"]
    dead: set[str] = set()
    for e in by.values():
        target = e["b"].get("target", {}).get("event_id") if e["kind"] == "retraction" else None
        if target is None:
            continue
        if target not in by or by[target]["seq"] >= e["seq"]:
            raise Refused("TARGET_NOT_FOUND")
        if by[target]["kind"] == "retraction":
            raise Refused("TARGET_IS_RETRACTION")
        dead.add(target)
        if by[target]["kind"] == "statement" and e["b"]["target"]["cascade"]:
            dead |= {i for i, r in root.items() if r == root[target] and by[i]["seq"] < e["seq"]}
    replaced = {by[i]["b"].get("supersedes") for i in root if i not in dead} - {None}
    statements, leaves = {}, set()
    for i, r in root.items():
        top = by[r]
        state = "retracted" if i in dead else "superseded" if i in replaced else "live"
        ttl = top["b"].get("ttl") or K.DEFAULT_TTL[top["b"]["provenance"]]
        s = Stated(i, by[i]["seq"], top["seq"], top["created_at"], top["b"]["provenance"], None if K.TTL[ttl] is None else top["created_at"] + K.TTL[ttl], by[i]["b"]["parsed"], state)
        statements[i] = s
        if state == "live":
            if r in leaves:
                raise Refused("MULTIPLE_LIVE_LEAVES")
            leaves.add(r)
            order.append((s.order, s.seq, i, "statement", by[i]["b"]))
    for e in by.values():
        if e["kind"] == "retraction" and "claim_id" in e["b"]["target"] or e["kind"] in ("merge", "alias") and e["id"] not in dead:
            order.append((e["seq"], e["seq"], e["id"], e["kind"], e["b"]))
    return statements, sorted(order, key=lambda x: x[:3])


def reduce_scope(scope_key: str, events: list[dict]) -> dict[str, list[dict]]:
    """The six tables of one scope as rows."""
    statements, order = prescan(events)
    scope = Scope(scope_key, statements)
    scope.anchor()
    for _, seq, i, kind, body in order:
        if kind == "statement":
            scope.state(statements[i])
        elif kind == "merge":
            scope.merge(seq, body)
        elif kind == "alias":
            scope.alias(seq, body)
        else:
            scope.retract(seq, body["target"]["claim_id"])
    return scope.rows()


def project(journal):
    """The projection of every scope of a journal by the fold, by parts."""
    from factweave.operators import parts

    return parts.project(journal)
