"""Operator 3 (native): document fingerprints by consistent weighted sampling.

Terms are words, weighted by their counts. For each of SAMPLES samples k and
each term, r and c are Gamma(2, 1) and b uniform, all from hashes of (term, k):

    t = floor(ln(weight) / r + b)
    ln a = ln c - r * (t - b + 1)

The least a of a text is its k-th sample. Two texts have the same k-th sample
with a probability equal to their generalised Jaccard similarity (sum of least
over sum of greatest weights), so the share of equal samples estimates it.

A document's neighbour is the next one in descending doc_id. Documents are dealt
into ranges of ids of about BUCKET documents each, RANGES at most, whose bounds
are quantiles of the ids: so they are alike in size whether ids are dense, sparse
or hashed. The first document of each range is also dealt, as a guest, to the
range that comes before it, so neighbours meet by a window over one range, and a
text is shuffled once. Bounds and first ids are at most RANGES numbers.

Null texts are empty; null ids come last. Equal texts have equal fingerprints; two empty texts have
likeness 1, an empty and another text 0. Rows that share a doc_id are ordered
by a hash of their text, in one range. An empty table gives an empty one; a single document
is its own neighbour. Other columns are ignored. No user-defined functions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave.llm.common import documents_text

SAMPLES = 32
#: Documents of a range of ids on the average, and ranges at most.
BUCKET, RANGES = 256, 65_536


def _uniforms(term: Column, k: int, n: int) -> list[Column]:
    """n uniform numbers in (0, 1) from hashes of a term's hash and k: 21 bits each, three from a hash."""
    out: list[Column] = []
    for i in range(0, n, 3):
        h = F.xxhash64(term, F.lit(k * 8 + i))
        out += [(F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 21) - 1)) + 0.5) / float(1 << 21) for shift in (43, 22, 1)]
    return out[:n]


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """ln a of a term for sample k."""
    u = _uniforms(term, k, 5)
    r = -F.log(u[0] * u[1])
    t_b = F.floor(log_weight / r + u[4]) - u[4]
    return F.log(-F.log(u[2] * u[3])) - r * (t_b + 1)


def weighted_terms(rows: DataFrame, text: str) -> DataFrame:
    """rows with <text>_terms, array<struct<h: hash, w: ln count>>: a text's distinct words, as the runs of its sorted hashes.

    Each step is a column of its own, read more than once, so it is computed once for each row.
    """
    plain = F.col(text)
    for c in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    hashes, ends = F.col("__hashes"), F.col("__ends")
    rows = rows.withColumn("__hashes", F.sort_array(F.transform(F.array_remove(F.split(plain, " "), ""), lambda w: F.xxhash64(w))))
    last = F.transform(hashes, lambda h, i: F.when((i + 1 == F.size(hashes)) | (F.get(hashes, i + 1) != h), i + 1))
    rows = rows.withColumn("__ends", F.filter(last, lambda x: x.isNotNull()))
    count = lambda x, i: x - F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
    terms = F.transform(ends, lambda x, i: F.struct(F.get(hashes, x - 1).alias("h"), F.log(count(x, i).cast("double")).alias("w")))
    return rows.withColumn(f"{text}_terms", terms).drop("__hashes", "__ends")


def signatures(rows: DataFrame, keys: list[str], texts: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys, with an array of samples for each text column, named by it; keys must tell rows apart. Null samples: no words."""
    for t in texts:
        rows = weighted_terms(rows, t)
    terms = F.flatten(F.array(*(F.transform(F.col(f"{t}_terms"), (lambda i: lambda x: F.struct(F.lit(i).alias("of"), x["h"].alias("h"), x["w"].alias("w")))(i)) for i, t in enumerate(texts))))
    made = rows.select(*keys, F.explode_outer(terms).alias("x")).select(*keys, "x.*")
    # a row is a term of one text, so it has one set of samples; the texts of a row meet afterwards
    each = made.groupBy(*keys, "of").agg(*(F.min(sample(F.col("h"), F.col("w"), k)).alias(f"s{k}") for k in range(samples)))
    each = each.select(*keys, "of", F.array(*(F.col(f"s{k}") for k in range(samples))).alias("samples"))
    none = F.array(*[F.lit(None).cast("double")] * samples)
    return each.groupBy(*keys).agg(*(F.coalesce(F.max(F.when(F.col("of") == i, F.col("samples"))), none).alias(t) for i, t in enumerate(texts)))


def fingerprint(samples: Column) -> Column:
    """Eight hexadecimal digits for each sample."""
    return F.array_join(F.transform(samples, lambda a: F.lower(F.lpad(F.hex(F.xxhash64(a).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples."""
    return sum((F.when(a[k].eqNullSafe(b[k]), 1).otherwise(0) for k in range(samples)), F.lit(0)) / float(samples)


def _held(values: list[int | None]) -> Column:
    """An array of at most RANGES numbers as a constant, which the optimizer reads once."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def ranges(docs: DataFrame) -> Column:
    """The number of the range of ids that doc_id is in: how many bounds are at most as large, by binary search."""
    n = max(1, min(RANGES, -(-docs.count() // BUCKET)))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], min(20 * n, 2_000_000)).alias("x")).first()["x"] if n > 1 else []
    bounds = sorted(set(bounds or []))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    held = _held(bounds)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(F.get(held, at + step - 1) <= F.col("doc_id"), step).otherwise(0))


def neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, place, guest, doc_id, text, next_text): bucket and place tell rows apart."""
    d = documents_text(docs)
    ids = d.select("doc_id")
    bucket = ranges(ids)
    heads = {r["bucket"]: r["head"] for r in ids.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}  # at most RANGES rows
    order = sorted(heads)
    size = order[-1] + 1 if order else 1
    into = dict(zip(order, order[1:] + order[:1]))  # where the first document of a range is a guest: the one above, and for the topmost the lowest
    head_of, into_of = (_held([x.get(i) for i in range(size)]) for x in (heads, into))
    own = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("guest"))
    also = F.struct(F.get(into_of, F.col("own")).cast("int").alias("bucket"), F.lit(True).alias("guest"))
    is_head = F.col("doc_id").eqNullSafe(F.get(head_of, F.col("own")))
    dealt = d.withColumn("own", bucket.cast("int")).withColumn("at", F.explode(F.when(is_head, F.array(own, also)).otherwise(F.array(own)))).select("doc_id", "text", "at.bucket", "at.guest")
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("doc_id"), F.xxhash64("text"))
    return dealt.withColumn("place", F.row_number().over(order)).withColumn("next_text", F.coalesce(F.lead("text").over(order), F.col("text")))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 3) as int))"))
    rows = neighbours(docs).select("bucket", "place", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    made = signatures(rows, ["bucket", "place", "guest", "doc_id", "n_chars", "edited_sha256"], ["text", "edited"])
    made = made.withColumn("next", F.coalesce(F.lead("text").over(Window.partitionBy("bucket").orderBy("place")), F.col("text")))
    return made.where(~F.col("guest")).select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.col("next")).alias("near_next"))
