"""Schemas of the journal, of statement bodies and of the six projected tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"long": T.LongType(), "string": T.StringType(), "int": T.IntegerType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


JOURNAL = _struct("seq:long id:string scope_key:string kind:string body:string actor:string branch:string session:string created_at:long")
DRAFT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("subject", "subject_kind")]
    + [T.StructField("subject_aliases", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("relation", "relation_label", "object", "object_kind")]
    + [T.StructField("object_aliases", T.ArrayType(T.StringType())), T.StructField("object_value", T.StringType())]
)
BODY = T.StructType(
    [
        T.StructField("raw_text", T.StringType()),
        T.StructField("parsed", T.ArrayType(DRAFT)),
        T.StructField("provenance", T.StringType()),
        T.StructField("ttl", T.StringType()),
        T.StructField("supersedes", T.StringType()),
        T.StructField("target", T.StructType([T.StructField("claim_id", T.StringType()), T.StructField("event_id", T.StringType()), T.StructField("cascade", T.BooleanType())])),
        T.StructField("keep", T.StringType()),
        T.StructField("absorb", T.StringType()),
        T.StructField("surface", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)

TABLES = {
    "statements": _struct("event_id:string scope_key:string state:string order_seq:long created_at:long provenance:string expires_at:long"),
    "entities": _struct("id:string scope_key:string name:string normal_name:string kind:string merged_into:string origin_seq:long"),
    "surface_forms": _struct("scope_key:string surface_norm:string entity_id:string origin:string"),
    "claims": _struct("id:string scope_key:string subject_id:string relation:string object_id:string object_value:string state:string origin_seq:long first_seen_at:long last_seen_at:long"),
    "claim_support": _struct("scope_key:string claim_id:string event_id:string draft_index:int live:int expires_at:long"),
    "id_redirects": _struct("scope_key:string old_id:string new_id:string kind:string reason:string"),
}
#: Primary keys, by which the canonical digest sorts.
KEYS = {
    "statements": ("event_id",),
    "entities": ("id",),
    "surface_forms": ("surface_norm", "entity_id"),
    "claims": ("id",),
    "claim_support": ("claim_id", "event_id"),
    "id_redirects": ("old_id",),
}
META = _struct("scope_key:string last_seq:long rules_version:int rebuilt_at:long")
#: The store's table of scopes: in which folder each scope's rows are.
SCOPES = _struct("scope_key:string folder:string last_seq:long rules_version:int rebuilt_at:long")
#: The store's search index.
POSTINGS = _struct("trigram:string scope_key:string seq:long")
MEASURED = _struct("scope_key:string n:long length:long")
