"""Operator 10: secret scans with a password guess-cost model.

Base kinds are patterns with a least length. Values in a credential context
are also segmented at least cost into dictionary words, dates, repeats,
keyboard walks, sequences and brute-force spans; a value that would take many
guesses is a secret too (kind guess). Positions are code points.

Null and empty texts have no spans. Repeated rows give repeated rows; an empty
table gives an empty one. Other columns pass through redact() unchanged.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from factweave.llm.common import documents_text, map_arrow, slices

KINDS = ("assign", "access", "hex", "guess")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

# The contract's patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is what is left of all runs
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Wider credential contexts, whose values the guess-cost model judges.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret(?:[_-]?key)?|(?:auth|access|refresh|bearer)?[_-]?token|api[_-]?key|private[_-]?key|credentials?|client[_-]?secret|authorization)["']?\x20*(?:[:=]|=>)\x20*(?:bearer\x20+)?["']?([^\s"'<>,;]{6,})""", re.I | re.A)
WORD_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "authorization")
#: log10 of the guesses from which a value counts as a secret.
HARD = 10.0

COMMON = """password 123456 qwerty letmein admin welcome monkey dragon master login princess sunshine shadow football
baseball superman iloveyou trustno hello freedom whatever secret changeme default example test guest root user demo
sample token value null none true false string your here insert placeholder redacted xxxx todo key api access auth
bearer basic private public client server database account email name first last house summer winter spring autumn
love money blue green red black white orange purple silver golden apple banana cherry computer internet system
manager office company service network security""".split()
LONGEST = 16


class Ranks:
    """Words by rank: COMMON first, then the pieces of a tokenizer's vocabulary, which stand in order of how early they were merged, so by how frequent they are."""

    def __init__(self, model_path: str | None = None):
        words = list(COMMON)
        if model_path is not None:
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=model_path)
            words += [w for w in (p.id_to_piece(i).lstrip("▁").lower() for i in range(p.get_piece_size())) if 3 <= len(w) <= LONGEST and w.isascii() and w.isalpha()]
        self.rank: dict[str, int] = {}
        for w in words:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))


@lru_cache(4)
def ranks(model_path: str | None = None) -> Ranks:
    return Ranks(model_path)


KEYS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b) for row in KEYS for s in (row, row[::-1]) for a, b in zip(s, s[1:])}
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
_LEET = str.maketrans("@4310$5!7", "aaeiossit")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")  # as long as the value, whatever else stands in it


def _alphabet(value: str) -> float:
    size = 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search("[0-9]", value)) + 33 * bool(re.search("[^A-Za-z0-9]", value))
    return math.log10(max(10, size))


def segments(value: str, known: Ranks) -> list[tuple[int, int, float]]:
    """(start, end, log10 of guesses) of everything in a value that a guesser tries before brute force: words, plain or in leet, dates, keyboard walks and sequences, and repeats."""
    n, lower = len(value), value.translate(_LOWER)
    plain, each = lower.translate(_LEET), _alphabet(value)
    out = [(m.start(), m.end(), math.log10(365 * 130) if len(m[0]) > 4 else 2.1) for m in _DATE.finditer(value)]
    for i in range(n):
        for size in range(3, min(known.longest, n - i) + 1):
            for form, extra in ((lower, 0.0), (plain, 0.5)):
                if rank := known.rank.get(form[i : i + size]):
                    caps = 0.0 if value[i : i + size] == lower[i : i + size] else 0.5
                    out.append((i, i + size, math.log10(rank + 1) + extra + caps))
    walk = 0
    for i in range(1, n + 1):
        if i == n or (lower[i - 1], lower[i]) not in _NEXT:
            if i - walk >= 3:
                out.append((walk, i, 1.5 + math.log10(i - walk) * 2))
            walk = i
    return out + [(m.start(), m.end(), len(m[1]) * each + math.log10((m.end() - m.start()) // len(m[1]))) for m in re.finditer(r"(.{1,8}?)\1{2,}", value)]


def guess_cost(value: str, known: Ranks | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of a value takes: each part costs its guesses and a choice of four kinds; time is linear in the length."""
    n, each, segment = len(value), _alphabet(value), math.log10(4)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for a, b, cost in segments(value, known or ranks()):
        ends[b].append((a, cost))
    best = [0.0] + [math.inf] * n
    open_ = [math.inf] * (n + 1)  # a brute-force span is running
    for j in range(1, n + 1):
        open_[j] = min(open_[j - 1], best[j - 1] + segment) + each
        best[j] = min([open_[j], *(best[i] + cost + segment for i, cost in ends[j])])
    return best[n]


def find(text: str, known: Ranks | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start and then by kind as listed."""
    found: list[tuple[int, int, str]] = []
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if ":" in text or "=" in text:
        lower = text.lower()
        if any(hint in lower for hint in WORD_HINTS):
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
            found += [(m.start(1), m.end(1), "guess") for m in CONTEXT.finditer(text) if guess_cost(m[1], known) >= HARD]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """One row per document: counts by base kind, a digest of the base spans, and all spans. model_path: a SentencePiece model whose vocabulary ranks words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                found = [find(t, ranks(model_path)) for t in texts]
                count = lambda kind: pa.array([sum(k == kind for _, _, k in spans) for spans in found], pa.int64())
                base = [_joined([x for x in spans if x[2] != "guess"]) for spans in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), count("assign"), count("access"), count("hex"), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array(list(map(_joined, found)), pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return map_arrow(documents_text(docs), run, SCHEMA)


def redacted(text: str, known: Ranks | None = None) -> str:
    """The text with each stretch of overlapping spans replaced by one mark, which names the first kind."""
    out, at, spans = [], 0, find(text, known)
    i = 0
    while i < len(spans):
        a, b, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][1])
        out += [text[at:a], f"[REDACTED:{kind.upper()}]"]
        at, i = b, i + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """The same rows and columns, with secrets masked in text and n_chars, where there is one, brought up to date; a null text stays null."""
    packed = docs.select(F.struct(F.lit(0).alias("text"), *(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("none"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                clean = [None if none else redacted(t, ranks(model_path)) for t, none in zip(texts, part.column("none").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(clean, pa.string())], ["row", "text"])

    done = map_arrow(packed, run, T.StructType([packed.schema["row"], T.StructField("text", T.StringType())]))
    length = lambda c: F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"row.`{c}`")
    return done.select(*(F.col("text") if c == "text" else length(c).alias(c) for c in docs.columns))
