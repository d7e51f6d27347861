"""Record and revise: validated requests against a store."""

from __future__ import annotations

import json
import re
import secrets
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from factweave import constants as K
from factweave.functions import identifiers as ids, text
from factweave.functions.identifiers import key as id_key
from factweave.operators import masking, ranking, validity
from factweave.operators.projection import Projection
from factweave.plans import dispatch

NOTE = 2048


# --- names


def name_hits(p: Projection, scope: str, names: set[str]) -> dict[str, list[tuple[str, str]]]:
    """The entities that normal names lead to, as (id, own normal name), in order of ids: one join for all names of a request.

    Of each name come its exact owners, then at most SEEDS + 1 others, so the
    number of rows is bounded by the request and an owner is never cut.
    """
    if not names:
        return {}
    asked = F.broadcast(p.entities.sparkSession.createDataFrame([(n,) for n in sorted(names)], "surface_norm string"))  # the names of one request
    entities = p.entities.where(F.col("scope_key") == scope).select(F.col("id").alias("entity_id"), F.coalesce("merged_into", "id").alias("to"))
    own = p.entities.where(F.col("scope_key") == scope).select(F.col("id").alias("to"), "normal_name")
    hits = p.surface_forms.where(F.col("scope_key") == scope).join(asked, "surface_norm").join(entities, "entity_id").join(own, "to").select("surface_norm", "to", "normal_name").distinct()
    exact = hits.where("surface_norm = normal_name")
    others = hits.where("surface_norm != normal_name").groupBy("surface_norm").agg(F.slice(F.array_sort(F.collect_set(F.struct(ids.numeric(F.col("to")).alias("order"), "to", "normal_name"))), 1, K.SEEDS + 1).alias("x"))
    rows = exact.unionByName(others.select("surface_norm", F.explode("x").alias("x")).select("surface_norm", "x.to", "x.normal_name")).collect()
    out: dict[str, list[tuple[str, str]]] = {}
    for r in sorted(rows, key=lambda r: id_key(r["to"])):
        out.setdefault(r["surface_norm"], []).append((r["to"], r["normal_name"]))
    return out


def decided(hits: list[tuple[str, str]], normal: str) -> dict:
    """{'status': resolved | ambiguous | not_found, ...}: the only hit, or the only one whose own name it is."""
    owners = [e for e, own in hits if own == normal]
    if len(hits) == 1 or len(owners) == 1:
        return {"status": "resolved", "entity_id": (owners or [hits[0][0]])[0]}
    return {"status": "ambiguous", "candidates": [e for e, _ in hits]} if hits else {"status": "not_found"}


def resolve_entity(store: dispatch.Store, scope: str, name: str) -> dict:
    """An entity by its id, which redirects are followed from, or by name."""
    if re.fullmatch(ids.OCCURRENCE, name) and name.startswith("e"):
        p = store.projection()
        to = _led(p.id_redirects, scope, name)
        found = p.entities.where((F.col("scope_key") == scope) & (F.col("id") == to)).select("id", "merged_into").first()
        return {"status": "resolved", "entity_id": found["merged_into"] or found["id"]} if found else {"status": "not_found"}
    normal = text.normal_name(name)
    return decided(name_hits(store.projection(), scope, {normal}).get(normal, []) if normal else [], normal or "")


def _led(redirects: DataFrame, scope: str, identifier: str) -> str:
    to = redirects.where((F.col("scope_key") == scope) & (F.col("old_id") == identifier)).select("new_id").first()
    return to["new_id"] if to else identifier


# --- drafts


def valid_draft(d: dict) -> str | None:
    """What is wrong with a draft, or None."""
    if text.normal_name(d.get("subject")) is None:
        return "EMPTY_SUBJECT"
    if d.get("relation") not in K.PREDICATES:
        return "UNKNOWN_RELATION"
    if (d.get("object") is None) == (d.get("object_value") is None):
        return "OBJECT_OR_LITERAL"
    if d.get("object") is not None and text.normal_name(d["object"]) is None:
        return "EMPTY_OBJECT"
    if d["relation"] == K.LABELLED and not (d.get("relation_label") or "").strip():
        return "LABEL_REQUIRED"
    if max(len(d.get(k) or "") for k in ("subject", "object", "object_value")) > K.NAME or len(d.get("relation_label") or "") > K.LABEL:
        return "TOO_LONG"
    if max(len(d.get(k) or []) for k in ("subject_aliases", "object_aliases")) > K.ALIASES:
        return "TOO_MANY_ALIASES"
    return None


def _has_secret(d: dict) -> bool:
    texts = [v for v in d.values() if isinstance(v, str)] + [a for k in ("subject_aliases", "object_aliases") for a in d.get(k) or []]
    return any(masking.findings(t) for t in texts)


class Names:
    """What names lead to while the drafts of one request are taken one by one: a draft that is refused leaves nothing behind."""

    def __init__(self, store: dispatch.Store, scope: str, drafts: list[dict]):
        asked = {text.normal_name(n) for d in drafts for n in self._all(d)} - {None}
        self.hits = name_hits(store.projection(), scope, asked)

    @staticmethod
    def _all(d: dict) -> list[str | None]:
        return [d.get("subject"), d.get("object"), *(d.get("subject_aliases") or []), *(d.get("object_aliases") or [])]

    def take(self, d: dict) -> dict | None:
        """None, and the draft's names are known from now on; or why it can't be taken."""
        new: list[tuple[str, tuple[str, str]]] = []
        for part in ("subject", "object"):
            normal = text.normal_name(d.get(part))
            if normal is None:
                continue
            known = [*self.hits.get(normal, []), *(e for n, e in new if n == normal and e not in self.hits.get(normal, []))]
            found = decided(known, normal)
            if found["status"] == "ambiguous":
                return {"status": "rejected", "problem": "AMBIGUOUS_ENTITY", "name": d[part], "candidates": found["candidates"]}
            entity = next((e for e in known if e[0] == found.get("entity_id")), (f"new:{normal}", normal))
            new += [(n, entity) for n in (normal, *map(text.normal_name, d.get(part + "_aliases") or [])) if n]
        for n, entity in new:
            if entity not in self.hits.setdefault(n, []):
                self.hits[n].append(entity)
        return None


def record(store: dispatch.Store, scope: str, raw_text: str, drafts: list[dict], now: int, provenance: str = "user_stated", ttl: str | None = None) -> dict:
    """Store a statement: the text masked, drafts checked one by one, repeated ones folded into the first.

    Status by draft: created, reinforced, superseded_previous, duplicate or
    rejected; an ambiguous name is rejected with its candidates.
    """
    if len(raw_text) > K.RAW_TEXT or len(drafts) > K.CLAIMS:
        raise ValueError("TOO_LARGE")
    status: list[dict] = []
    kept, seen = [], {}
    problems = [valid_draft(d) or ("SECRET_IN_DRAFT" if _has_secret(d) else None) for d in drafts]
    store = store.current()
    names = Names(store, scope, [d for d, p in zip(drafts, problems) if p is None])
    for d, problem in zip(drafts, problems):
        same = None if problem else (text.normal_name(d["subject"]), d["relation"], text.normal_name(d.get("object")), text.normal_literal(d.get("object_value")))
        if problem:
            status.append({"status": "rejected", "problem": problem})
        elif same in seen:
            status.append({"status": "duplicate", "of": seen[same]})
        elif refused := names.take(d):
            status.append(refused)
        else:
            seen[same] = len(status)
            status.append({"status": "created", "draft": len(kept)})
            kept.append(d)
    before = store.projection().claims.where(F.col("scope_key") == scope)
    ttl = ttl or K.DEFAULT_TTL[provenance]
    done = dispatch.execute(store, [(scope, "statement", {"raw_text": masking.masked(raw_text), "parsed": kept, "provenance": provenance, "ttl": ttl})], now)
    p = store.current().projection()
    mine = p.claim_support.where((F.col("scope_key") == scope) & (F.col("event_id") == done["events"][0])).join(p.claims.select("scope_key", F.col("id").alias("claim_id"), "subject_id", "relation"), ["scope_key", "claim_id"])
    old = {r["id"]: r for r in before.join(mine.select(F.col("subject_id")).distinct(), "subject_id", "left_semi").where(F.col("relation") == K.SINGLE).unionByName(before.join(mine.select(F.col("claim_id").alias("id")), "id", "left_semi")).select("id", "state", "relation", "subject_id").collect()}
    by = {r["draft_index"]: r for r in mine.collect()}
    for s in status:
        if "draft" in s:
            c = by[s["draft"]]
            s["claim_id"] = c["claim_id"]
            rival = any(o["state"] == "active" and o["relation"] == K.SINGLE and o["subject_id"] == c["subject_id"] and i != c["claim_id"] for i, o in old.items())
            s["status"] = "superseded_previous" if c["relation"] == K.SINGLE and rival else "reinforced" if old.get(c["claim_id"]) and old[c["claim_id"]]["state"] == "active" else "created"
    return {"event_id": done["events"][0], "last_seq": done["last_seq"], "drafts": status}


# --- revise


@dataclass(frozen=True)
class Target:
    """What a revision is about: a claim, an event, or a subject's valid claim. A statement takes its whole chain along unless cascade is False."""

    claim_id: str | None = None
    event_id: str | None = None
    subject: str | None = None
    relation: str | None = None
    cascade: bool | None = None


def _checked(note: str | None) -> dict:
    if note is not None and (len(note) > NOTE or masking.findings(note)):
        raise ValueError("INVALID_NOTE")
    return {} if note is None else {"note": note}


def _found(store: dispatch.Store, scope: str, target: Target, now: int) -> dict:
    """{'status': 'found', 'target': body of the retraction, 'affected': claims, 'dead': whether nothing is left to retract}, or why not."""
    p = store.projection()
    if target.subject is not None:
        entity = resolve_entity(store, scope, target.subject)
        if entity["status"] != "resolved":
            return entity
        journal = store.journal().where(F.col("scope_key") == scope)
        valid = validity.valid_claims(p, validity.claim_aggregate(p, journal, now, scope)).where(F.col("subject_id") == entity["entity_id"])
        if target.relation is not None:
            valid = valid.where(F.col("relation") == target.relation)
        name = p.entities.select("scope_key", F.col("id").alias("subject_id"), F.col("name").alias("subject"))
        other = p.entities.select("scope_key", F.col("id").alias("object_id"), F.col("name").alias("object"))
        shown = ranking.brief(F.col("subject"), F.col("relation"), F.col("relation_label"), F.coalesce("object", "object_value"))
        rows = valid.join(name, ["scope_key", "subject_id"]).join(other, ["scope_key", "object_id"], "left").select("claim_id", shown.alias("text")).orderBy(ids.numeric(F.col("claim_id"))).limit(K.SEEDS + 1).collect()
        if len(rows) != 1:
            return {"status": "ambiguous", "candidates": [r.asDict() for r in rows]} if rows else {"status": "not_found"}
        return _found(store, scope, Target(claim_id=rows[0]["claim_id"]), now)
    supports = p.claim_support.where(F.col("scope_key") == scope)
    if target.claim_id is not None:
        claim = _led(p.id_redirects, scope, target.claim_id)
        if not p.claims.where((F.col("scope_key") == scope) & (F.col("id") == claim)).take(1):
            return {"status": "not_found"}
        dead = not supports.where((F.col("claim_id") == claim) & (F.col("live") == 1)).take(1)
        return {"status": "found", "target": {"claim_id": target.claim_id}, "affected": [claim], "dead": dead, "kind": "claim"}
    journal = store.journal().where(F.col("scope_key") == scope)
    e = journal.where(F.col("id") == target.event_id).select("kind").first()
    if e is None or e["kind"] == "retraction" or (e["kind"] != "statement" and target.cascade is not None):
        return {"status": "not_found"}
    if e["kind"] == "statement":
        affected = sorted((r["claim_id"] for r in supports.where(F.col("event_id") == target.event_id).select("claim_id").distinct().collect()), key=id_key)
        dead = bool(p.statements.where((F.col("scope_key") == scope) & (F.col("event_id") == target.event_id) & (F.col("state") == "retracted")).take(1))
        return {"status": "found", "target": {"event_id": target.event_id, "cascade": target.cascade is not False}, "affected": affected, "dead": dead, "kind": "statement"}
    undone = journal.where((F.col("kind") == "retraction") & (F.get_json_object("body", "$.target.event_id") == target.event_id))
    return {"status": "found", "target": {"event_id": target.event_id}, "affected": [], "dead": bool(undone.take(1)), "kind": e["kind"]}


def retract(store: dispatch.Store, scope: str, target: Target, now: int, note: str | None = None) -> dict:
    """Applied, unchanged if nothing of the target is live any more, ambiguous with candidates, or not_found."""
    more = _checked(note)
    store = store.current()
    found = _found(store, scope, target, now)
    if found["status"] != "found":
        return found
    if found["dead"]:
        return {"status": "unchanged", "affected": found["affected"]}
    return {"status": "applied", "affected": found["affected"], **dispatch.execute(store, [(scope, "retraction", {"target": found["target"], **more})], now)}


def correct(store: dispatch.Store, scope: str, target: Target, raw_text: str, draft: dict, now: int, provenance: str = "user_stated", ttl: str | None = None, note: str | None = None) -> dict:
    """A retraction of a claim or a statement and the statement that takes its place, in one batch. A draft with a secret is refused as a whole."""
    more = _checked(note)
    if problem := valid_draft(draft) or ("SECRET_IN_DRAFT" if _has_secret(draft) else None):
        return {"status": "rejected", "problem": problem}
    store = store.current()
    found = _found(store, scope, target, now)
    if found["status"] != "found":
        return found
    if found["kind"] not in ("claim", "statement"):
        return {"status": "rejected", "problem": "TARGET_NOT_A_STATEMENT"}
    if refused := Names(store, scope, [draft]).take(draft):
        return refused
    body = {"raw_text": masking.masked(raw_text), "parsed": [draft], "provenance": provenance, "ttl": ttl or K.DEFAULT_TTL[provenance]}
    undo = [] if found["dead"] else [(scope, "retraction", {"target": found["target"], **more})]
    return {"status": "applied", "affected": found["affected"], **dispatch.execute(store, [*undo, (scope, "statement", body)], now)}


def merge(store: dispatch.Store, scope: str, keep: str, absorb: str, now: int, note: str | None = None) -> dict:
    """Merge two entities by name or id."""
    more = _checked(note)
    store = store.current()
    found = [resolve_entity(store, scope, n) for n in (keep, absorb)]
    for f in found:
        if f["status"] != "resolved":
            return f
    a, b = (f["entity_id"] for f in found)
    return {"status": "unchanged"} if a == b else {"status": "applied", **dispatch.execute(store, [(scope, "merge", {"keep": a, "absorb": b, **more})], now)}


def alias(store: dispatch.Store, scope: str, surface: str, entity: str, now: int, note: str | None = None) -> dict:
    """Confirm a name of an entity, by name or id; unchanged if it is confirmed already."""
    more = _checked(note)
    normal = text.normal_name(surface)
    if normal is None or len(text.trimmed(surface)) > K.TERM_POINTS:
        return {"status": "rejected", "problem": "INVALID_SURFACE"}
    if masking.findings(surface):
        return {"status": "rejected", "problem": "SECRET_IN_SURFACE"}
    store = store.current()
    found = resolve_entity(store, scope, entity)
    if found["status"] != "resolved":
        return found
    p = store.projection()
    to = p.entities.where(F.col("scope_key") == scope).select(F.col("id").alias("entity_id"), F.coalesce("merged_into", "id").alias("to")).where(F.col("to") == found["entity_id"])
    known = p.surface_forms.where((F.col("scope_key") == scope) & (F.col("surface_norm") == normal) & (F.col("origin") == "confirmed")).join(to, "entity_id", "left_semi")
    if known.take(1):
        return {"status": "unchanged"}
    return {"status": "applied", **dispatch.execute(store, [(scope, "alias", {"surface": surface, "entity_id": found["entity_id"], **more})], now)}


# --- reinterpretation


@dataclass
class Approvals:
    """One-time approvals of reinterpretations, bound to what was shown, for a quarter of an hour."""

    held: dict[str, tuple] = field(default_factory=dict)

    def issue(self, bound: tuple, now: int) -> str:
        token = secrets.token_urlsafe(24)
        self.held[token] = (bound, now + K.APPROVAL_SECONDS)
        return token

    def redeem(self, token: str, bound: tuple, now: int) -> bool:
        own, until = self.held.pop(token, (None, 0))
        return own == bound and now < until


def approval_of(store: dispatch.Store, scope: str, event_id: str, drafts: list[dict]) -> tuple | None:
    """What an approval is bound to: scope, statement, the scope's last seq, text, provenance, lifetime and the new drafts; None for what is no statement of the scope."""
    journal = store.journal().where(F.col("scope_key") == scope)
    e = journal.where((F.col("id") == event_id) & (F.col("kind") == "statement")).select("body").first()
    if e is None:
        return None
    own = json.loads(e["body"])
    return scope, event_id, journal.agg(F.max("seq")).first()[0], own["raw_text"], own["provenance"], own["ttl"], json.dumps(drafts, sort_keys=True)


def reinterpret(store: dispatch.Store, approvals: Approvals, token: str, scope: str, event_id: str, drafts: list[dict], now: int) -> dict:
    """New drafts for a statement, at its root's place; nothing happens unless the approval fits all of it and every draft is clean."""
    store = store.current()
    bound = approval_of(store, scope, event_id, drafts)
    if bound is None:
        return {"status": "not_found"}
    if not approvals.redeem(token, bound, now):
        return {"status": "rejected", "problem": "APPROVAL_MISMATCH"}
    if any(valid_draft(d) or _has_secret(d) for d in drafts):
        return {"status": "rejected", "problem": "INVALID_DRAFT"}
    body = {"raw_text": bound[3], "parsed": drafts, "provenance": bound[4], "ttl": bound[5], "supersedes": event_id}
    return {"status": "applied", **dispatch.execute(store, [(scope, "statement", body)], now)}


def reinterpretation_candidates(statements: DataFrame, now: int, provenances: tuple[str, ...] = ("inferred",), empty_only: bool = False) -> DataFrame:
    """Live statements that a maintainer may want to read anew."""
    found = validity.live_statements(statements, now).where(F.col("provenance").isin(*provenances))
    return found.where(F.size("parsed") == 0) if empty_only else found
