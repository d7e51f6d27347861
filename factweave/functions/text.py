"""Text functions of the claims model.

White space is Unicode's, with the byte-order mark, which a plain trim() does
not know. Compatibility normalisation (NFKC) has no built-in, so the identities
of names and literals are Arrow functions with a fast way for ASCII.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

from factweave import constants as K

_EDGE = "\\s\\p{IsWhite_Space}﻿"
_PY_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
_TRIM = "".join(c for c in _PY_SPACE if c not in "\x1c\x1d\x1e\x1f\x85") + "﻿"
_SEPARATORS = re.compile("[" + re.escape("".join(c for c in _PY_SPACE if c not in "\x1c\x1d\x1e\x1f")) + "_\\-]+")


def trimmed(text: str) -> str:
    return text.strip(_TRIM)


def normal_name(text: str | None) -> str | None:
    """A name's identity: trimmed, NFKC, lower case, without white space, underscores and hyphens; None if nothing is left."""
    if text is None:
        return None
    text = trimmed(text)
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return _SEPARATORS.sub("", text.lower()) or None


def normal_literal(text: str | None) -> str | None:
    """A literal's identity: trimmed, NFKC, case kept; None if nothing is left."""
    if text is None:
        return None
    text = trimmed(text)
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)) or None


def normal_kind(text: str | None) -> str | None:
    if text is None:
        return None
    text = unicodedata.normalize("NFKC", trimmed(text)).lower()
    return text if 0 < len(text) <= K.KIND else None


def _over(fn):
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(fn, na_action="ignore")

    return run


def _column(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _is_ascii(column: Column) -> Column:
    return F.length(column) == F.octet_length(column)


def _by_alphabet(column: Column, ascii_form: Column, fn) -> Column:
    """ASCII values by built-in functions; the others go to Python, where ASCII ones are nulls that cost nothing."""
    ascii_only = _is_ascii(column)
    return F.when(ascii_only, ascii_form).otherwise(_over(fn)(F.when(~ascii_only, column)))


def normalize_name(column: Column | str) -> Column:
    c = _column(column)
    return _by_alphabet(c, ascii_name(c), normal_name)


def normalize_literal(column: Column | str) -> Column:
    c = _column(column)
    return _by_alphabet(c, F.nullif(trim(c), F.lit("")), normal_literal)


def normalize_kind(column: Column | str) -> Column:
    c = _column(column)
    lower = F.lower(trim(c))
    return _by_alphabet(c, F.when(F.length(lower).between(1, K.KIND), lower), normal_kind)


def trim(column: Column | str) -> Column:
    """JVM-side trim of Unicode white space and the byte-order mark."""
    return F.regexp_replace(column, f"^[{_EDGE}]+|[{_EDGE}]+$", "")


def ascii_name(column: Column | str) -> Column:
    """normalize_name() for ASCII values: built-in functions only."""
    return F.nullif(F.regexp_replace(F.lower(trim(column)), r"[\s_\-]+", ""), F.lit(""))


def relation_label(label: Column) -> Column:
    """A trimmed label of at most 256 code points, or null; relates_to needs one, which validation sees to."""
    t = trim(label)
    return F.when((F.length(t) > 0) & (F.length(t) <= K.LABEL), t)


def shown(column: Column, suffix: str = "") -> Column:
    """At most 80 code points: longer texts end in an ellipsis; a suffix is kept whole."""
    room = K.DISPLAY - len(suffix)
    cut = F.when(F.length(column) > room, F.concat(F.substring(column, 1, room - 1), F.lit("…"))).otherwise(column)
    return F.concat(cut, F.lit(suffix)) if suffix else cut


def iso_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


#: Lower case goes character by character in phrase matches: a sigma is the same at a word's end, and a dotted capital i only itself.
_KEEP, _KEPT = "İ", "\ue000"


def folded(column: Column | str) -> Column:
    """Case-folded text for phrase matches."""
    return F.translate(F.lower(F.translate(_column(column), _KEEP, _KEPT)), "ς" + _KEPT, "σ" + _KEEP)


def fold(value: str) -> str:
    """The same in Python."""
    return value.replace(_KEEP, _KEPT).lower().replace("ς", "σ").replace(_KEPT, _KEEP)


def occurrences(text: Column, phrase: str) -> Column:
    """Overlapping occurrences of a folded phrase in a folded text."""
    return F.regexp_count(text, F.lit("(?=" + re.escape(phrase) + ")"))
