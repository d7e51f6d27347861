"""A training-data pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Between stages the rows are written as
Parquet and read again, so a lost executor costs one stage at most.

All stages give an empty table for an empty one, and keep further columns, whatever
their names. A null text is an empty text: the quality stage rejects both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import jaccard, mixing, quality, secret_scan, sentencepiece_codec
from factweave.llm.common import materialize, table
from factweave.llm.queries import model_path
from factweave.scratch import scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the thresholds of their language and length. Repeated rows are judged alike; a null language is a language."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, 0.8 or more. The least id stays, null ids last; of ties and repeated rows, one."""
    return jaccard.representatives(docs, k=5, num=80, den=100)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, row by row, with secrets masked in their texts and n_chars brought up to date."""
    return secret_scan.redact(docs, model_path())


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: those without words never, a null source as a source of its own; repeated rows share their copies."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mixture: how many ids, and digests of the ids and of the text that they decode to; repeated rows give repeated rows."""
    return sentencepiece_codec.encode_digest(docs, model_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: Perplexities, components, spans and ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():  # a stage's own tables go with it
            docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.split()[0], outlive=True)
    return STAGES[-1][1](spark, docs, sf_dir)
