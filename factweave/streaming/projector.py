"""A streaming projector: an append-only journal as source, a store as sink.

Late events change a scope's past (their order is their root's), so a touched
scope is projected anew from its journal; others keep their rows. Expiry is
judged at read time, so no timers are needed. Each epoch is one version of the
store: readers see all six tables of it at once, and rows that a scope no longer
has are gone. The version names its epoch, so a batch that is run again after it
was published changes nothing; an event that arrives twice counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from factweave import schema
from factweave.plans import dispatch


def journal_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Journal files as they arrive."""
    return spark.readStream.schema(schema.JOURNAL).option("maxFilesPerTrigger", files).parquet(path)


def apply_epoch(store: dispatch.Store, new: DataFrame, epoch: int) -> dispatch.Store:
    """The store after one epoch's events, which carry their own seq and id."""
    store = store.current()
    if epoch <= store.version.epoch:
        return store
    new = new.dropDuplicates(["id"]).join(store.journal().select("id"), "id", "left_anti").persist()
    try:
        top = new.agg(F.max("seq").alias("seq"), F.max("created_at").alias("now")).first()
        if top["seq"] is None:
            return store
        return store.written(new, top["now"], max(store.version.last_seq, top["seq"]), epoch)
    finally:
        new.unpersist()


def project_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the store under `out` up to date until the source is read."""

    def batch(new: DataFrame, epoch: int) -> None:
        apply_epoch(dispatch.Store(new.sparkSession, out), new, epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def projected(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of the version that is current now."""
    return dispatch.Store(spark, out).current().table(name)
