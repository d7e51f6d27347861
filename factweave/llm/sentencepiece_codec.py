"""Operator 6: SentencePiece encoding and decoding of whole texts.

Null and empty texts have only the begin and end ids and decode to "". Repeated
rows give repeated rows; an empty table gives an empty one. Any columns beside
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factweave.llm.common import documents_text, map_arrow, slices
from factweave.llm.pieces import BOS, EOS, codec

ENCODED = "doc_id long, n_tokens long, ids array<int>, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _parts(batches: Iterator[pa.RecordBatch], model_path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[str]]]:
    for batch in batches:
        for part, texts in slices(batch):
            coder = codec(model_path)
            ids = [np.frombuffer(x, "<u4") for x in coder.encode_batch(texts)]
            ids = [np.concatenate(([BOS], x, [EOS])).astype("<u4") for x in ids]
            yield part, ids, [coder.decode(x) for x in ids]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every text; model_path must be readable on all executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, decoded in _parts(batches, model_path):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return map_arrow(documents_text(docs), run, ENCODED)


def encode_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests are made where the ids are, so ids needn't travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, decoded in _parts(batches, model_path):
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_arrow(documents_text(docs), run, DIGEST)
