"""Fixed values of the claims model."""

from __future__ import annotations

# Relations, their default predicates, and the single-valued one.
PREDICATES = {"uses": "사용", "rejects": "거부", "contains": "포함", "describes": "=", "relates_to": "관련"}
SINGLE = "describes"
LABELLED = "relates_to"
OPPOSITE = {"uses": "rejects", "rejects": "uses"}

# Lifetimes in seconds (None: no end) and the default by provenance.
TTL = {"session": 43_200, "weeks": 2_592_000, "permanent": None}
DEFAULT_TTL = {"user_stated": "permanent", "observed": "permanent", "inferred": "weeks"}
PROVENANCE_RANK = {"user_stated": 3, "observed": 2, "inferred": 1}
ORIGIN_RANK = {"agent_supplied": 1, "name": 2, "confirmed": 3}

# Bounds.
MAX_SAFE = 2**53 - 1
REDIRECT_HOPS = 32
QUERY_POINTS, TERM_POINTS, TERMS, SEEDS, TERM_LEAST = 4096, 256, 10, 50, 2
PHRASES, PHRASE_LEAST, FTS_ROWS = 10, 3, 20
FANOUT, DEPTHS, DEPTH = 30, (1, 2, 3), 2
LIMITS, LIMIT, OVERVIEW_SEEDS = (1, 50), 10, 10
RECENT = 2_592_000
RAW_TEXT, NAME, LABEL, KIND, CLAIMS, ALIASES = 32_768, 1_024, 256, 64, 100, 20
DISPLAY = 80
DETAIL_BYTES, DETAIL_ROWS = 1 << 20, 100
APPROVAL_SECONDS = 900
RULES_VERSION = 1

EVENT_ID = r"^ev_[0-7][0-9A-HJKMNP-TV-Z]{25}$"
SCOPE_KEY = r"^u:[A-Za-z0-9._-]{1,64}/p:[A-Za-z0-9._-]{1,64}$"
KINDS = ("statement", "retraction", "merge", "alias")
STATES = ("live", "retracted", "superseded")
