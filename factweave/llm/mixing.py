"""Operator 5 (native): mixing sources to target weights by systematic sampling.

Each source's target is a share of all words by its weight, at most `most`
times its own words; what is above is shared anew by weight among the others.
A document's expected copies are its source's target over its source's words.
Within a source, in order of size, the expected copies are summed up, one
random offset is added, and the document is emitted once for each integer
boundary that its interval crosses. Neighbours are alike in size, so the words
taken follow the target closely.

The prefix sum needs each document's place in its source. It is counted in two
levels: documents are dealt into cells (source, size class, hash bucket), which
split a source that holds a third of all rows; places within a cell and the
counts of the cells before it add up to the place.

A null text has size 0; a null source is a source of its own, the last. Sources
without words have target 0 and none of their documents is taken. Rows that
repeat a doc_id are documents of their own. An empty table gives an empty one.
Weights go to sources by code point, so reruns agree. No user-defined
functions: DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave.llm.common import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
#: Hash buckets of each size class of a source.
BUCKETS = 1024
SEED = 20_240_517


def words(text: str = "text") -> Column:
    """The number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water-filling in closed form.

    A row for each source, so windows without a key see as many rows as there are
    sources. With the sources by cap over weight, the ones that stop at their caps are
    those before the first whose cap reaches its share of what is left.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    i = (F.row_number().over(by_code) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), i.cast("int") + 1)
    cap = F.col("source_size").cast("double") * most
    fill = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    found = sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("share", left / weight_left)
    stops = F.col("cap") <= F.col("share") * F.col("weight")
    level = F.first(F.when(~stops, F.col("share")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("level", level).select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def copies(docs: DataFrame, keys: list[str], weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """docs with source_size, target and the number of copies; docs has source, size and keys that order documents of one size."""
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    cell = ["size_class", "bucket"]
    dealt = docs.withColumn("size_class", F.floor(F.log2(F.col("size") + 1)).cast("int")).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    cells = dealt.groupBy("source", *cell).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    cells = cells.alias("c").join(targets(sources, weights, most).alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.*", "source_size", "target")
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy("source", *cell).orderBy("size", *keys)))
    on = F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size_class") == F.col("c.size_class")) & (F.col("d.bucket") == F.col("c.bucket"))
    found = placed.alias("d").join(cells.alias("c"), on).select(*(F.col(f"d.{k}") for k in docs.columns), "source_size", "target", (F.col("place") + F.col("ahead")).alias("place"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("\x00"))), F.lit(1 << 30)) / float(1 << 30)
    upto = lambda n: F.floor(F.least(each * n, n * F.lit(float(most))) + offset)
    return found.withColumn("copies", F.when(F.col("size") > 0, upto(F.col("place")) - upto(F.col("place") - 1)).otherwise(0).cast("long")).drop("place")


def _sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, source, size) of all rows, written: sums and places need them several times, texts are read once."""
    return materialize(docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("source").cast("string").alias("source"), words().alias("size")), "mix-sizes")


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): taken are the words of all copies."""
    return copies(_sizes(docs), ["doc_id", "text_key"]).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixture: the rows of docs, each as many times as mix_report() takes it, with the same columns.

    Copies are counted on ids and sizes; texts are dealt once, to meet their
    number. Rows of the same id, source and text share the copies that fall to
    them in any order. Rows travel as one struct, so no name clashes.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("source").isNull(), F.coalesce(F.col("source").cast("string"), F.lit("")))
    taken = copies(_sizes(docs), ["doc_id", "text_key"]).select(F.xxhash64(key, "text_key").alias("key"), "copies")
    numbers = taken.groupBy("key").agg(F.array_sort(F.collect_list("copies")).alias("each")).where(F.exists("each", lambda n: n > 0))  # a number for each repeated row
    packed = docs.select(F.xxhash64(key, F.xxhash64("text")).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))  # the join has dealt the rows out by key already
    met = packed.join(numbers.hint("merge"), "key").withColumn("nth", nth).withColumn("copies", F.get("each", F.col("nth") - 1)).where("copies > 0")
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
