"""What the text operators share: scratch tables, Arrow maps and text coercion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factweave.scratch import materialize, scratch_root  # noqa: F401  for the operators

#: Rows of an Arrow batch: texts may be long, so batches are short.
BATCH_ROWS = 512
#: Characters that a Python worker handles at a time within a batch.
SLICE_CHARS = 2_000_000


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with batches short enough for texts of any length. The batch size is a setting of the session, read when the plan runs, so it stays set."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def documents_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text): null texts become empty; other columns are dropped, so their names can't clash."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of about SLICE_CHARS characters, with the texts of each."""
    texts = batch.column(column).to_pylist()
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_CHARS or i == len(texts) - 1:
            yield batch.slice(at, i + 1 - at), texts[at : i + 1]
            at, size = i + 1, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
