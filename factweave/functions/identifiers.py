"""Occurrence identifiers e<seq>.<position> and c<seq>.<draft>: text to show, two numbers to sort by."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OCCURRENCE = r"^[ec][1-9][0-9]*\.(0|[1-9][0-9]*)$"


def make(letter: str, seq: Column, position: Column) -> Column:
    return F.concat(F.lit(letter), seq.cast("string"), F.lit("."), position.cast("string"))


def seq_of(column: Column) -> Column:
    return F.regexp_extract(column, r"^[ec]([0-9]+)\.", 1).cast("long")


def position_of(column: Column) -> Column:
    return F.regexp_extract(column, r"\.([0-9]+)$", 1).cast("int")


def numeric(column: Column) -> Column:
    """A sortable pair: string order would put e10.0 before e2.0."""
    return F.struct(seq_of(column).alias("seq"), position_of(column).alias("position"))


def event_id(seq: Column) -> Column:
    return F.concat(F.lit("ev_"), F.lpad(seq.cast("string"), 26, "0"))


def key(identifier: str) -> tuple[int, int]:
    """The same order in Python."""
    seq, position = identifier[1:].split(".")
    return int(seq), int(position)
