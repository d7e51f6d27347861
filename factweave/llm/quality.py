"""Operator 8: a quality classifier by Kneser-Ney perplexity.

An interpolated modified Kneser-Ney model of ORDER characters is trained on all
trusted text (labels with quality 1). A code point below EXACT is its own class.
All others that stand in the documents are counted: the most frequent have classes
of their own as far as there are any, and the rest are two classes each, one after
another, so no two characters look alike however many a script has. An n-gram is a
number of ORDER * 12 bits.

Counting is sharded: each task adds up its own n-grams, the counts meet by n-gram,
and continuation counts, discounts, context totals and probabilities come from joins
and sums of the counts by context. No n-gram is left out. Workers hold the HELD most
frequent rows of each table. As long as these are all rows, documents are scored
from them alone; beyond, a document's n-grams that they can't tell are joined with
the whole tables, so its perplexity is the same at any HELD.

A document's perplexity is compared with quantiles of the trusted documents of its
language and of about its length: it is rejected above the upper one, and below
the lower one, where a text says the same over and over. The longer the texts, the
closer together their quantiles. A length with fewer than LEAST_TRUSTED trusted
documents takes its language's quantiles, and a language without any those over
all of them.

Null and empty texts have no perplexity and are rejected. A null language is a
language. Repeated rows give repeated rows; repeated labels count once, and a
document is trusted only if no label of it has quality 0. Without trusted
documents nothing can be judged and all texts are kept. An empty table gives an
empty one. Other columns of documents pass through keep() unchanged, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from factweave.llm.common import map_arrow, materialize, slices

ORDER = 5
BITS = 12
CLASSES, EXACT = 1 << BITS, 2048
START = 0
#: A character that the documents don't have; classes of the other code points from EXACT on lie between.
UNSEEN = CLASSES - 1
OTHERS = UNSEEN - EXACT
#: Rows of each table of the model that a worker holds; the others are joined. A smaller model (train) has the n-grams that are at least one in KEEP.
HELD, KEEP = 2_000_000, 200_000
#: No probability counts as less.
LEAST = 1e-12
#: The shares of trusted documents of a language that its thresholds cut off, and a factor on both thresholds.
LOW, HIGH, MARGIN = 0.001, 0.995, 1.02
#: Classes of length are powers of two.
LEAST_TRUSTED = 100
FLUSH_GRAMS = 1_000_000


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)


class Alphabet:
    """Characters to classes: one below EXACT is itself, and of the others (points, the most frequent first) the last are a lead and a second class."""

    def __init__(self, points: np.ndarray):
        self.order = np.argsort(points)
        self.points = points[self.order]
        self.leads = max(0, -(-(len(points) - OTHERS) // (OTHERS - 1)))  # each takes a class and gives OTHERS pairs

    def classes(self, text: str) -> np.ndarray:
        """The classes of a text: one or two for each character."""
        out = _points(text)
        far = np.flatnonzero(out >= EXACT)
        if not len(far):
            return out
        rank = np.full(len(far), -1)
        if len(self.points):
            at = np.minimum(np.searchsorted(self.points, out[far]), len(self.points) - 1)
            rank = np.where(self.points[at] == out[far], self.order[at], -1)
        pair = rank - (OTHERS - self.leads)
        out[far] = np.where(rank < 0, UNSEEN, EXACT + np.where(pair < 0, self.leads + rank, pair // OTHERS))
        two = pair >= 0
        return np.insert(out, far[two] + 1, EXACT + pair[two] % OTHERS) if two.any() else out


def alphabet(docs: DataFrame) -> Alphabet:
    """That of all texts: every code point from EXACT on is counted. They are at most as many as Unicode has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for batch in batches:
            for _, texts in slices(batch):
                points = _points("".join(t for t in texts if not t.isascii()))
                if len(points) and points.max() >= EXACT:
                    own = np.bincount(points[points >= EXACT], minlength=len(n))
                    own[: len(n)] += n
                    n = own
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["point", "n"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    got = map_arrow(texts, run, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point").select("point").toPandas()
    return Alphabet(got["point"].to_numpy(np.int64))


def grams(texts: list[str], letters: Alphabet = Alphabet(np.zeros(0, np.int64))) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams that end at each class of texts, one after another; how many of each). A text follows ORDER - 1 times START."""
    pad = np.full(ORDER - 1, START, np.int64)
    each = [np.concatenate([pad, letters.classes(t)]) for t in texts]
    codes, sizes = np.concatenate([np.zeros(0, np.int64), *each]), np.array([len(x) - ORDER + 1 for x in each], np.int64)
    if not len(codes):
        return codes, sizes
    out = codes.copy()
    for k in range(1, ORDER):
        out[k:] |= codes[:-k] << BITS * k
    own = np.ones(len(codes), bool)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - ORDER + 1
    own[(starts[:, None] + np.arange(ORDER - 1)).ravel()] = False
    return out[own], sizes


def trusted(labels: DataFrame) -> DataFrame:
    """(doc_id) of documents whose labels all have quality 1."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def gram_counts(docs: DataFrame, letters: Alphabet) -> DataFrame:
    """(gram, n) of all texts; a task sends its sums when there are many."""
    shared = docs.sparkSession.sparkContext.broadcast(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, texts in slices(batch):
                own, n = np.unique(grams(texts, shared.value)[0], return_counts=True)
                every = np.concatenate([keys, own])
                keys, at = np.unique(every, return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) > FLUSH_GRAMS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(texts, run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _shares(counts: DataFrame) -> DataFrame:
    """(gram, n, seen, context, all, left) of the n-grams of one order: their discounted share of what follows their context, and what all of the context leaves.

    Modified Kneser-Ney: discounts for counts 1, 2 and more, from the counts of counts.
    """
    by = counts.agg(*(F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    ones = by["n1"] or 0
    y = ones / (ones + 2 * by["n2"]) if ones else 0.0
    discount = [max(0.0, k - (k + 1) * y * by[f"n{k + 1}"] / by[f"n{k}"]) if ones and by[f"n{k}"] else 0.5 for k in (1, 2, 3)]
    d = F.element_at(F.array(*map(F.lit, discount)), F.least(F.col("n"), F.lit(3)).cast("int"))
    own = counts.withColumn("context", F.shiftright("gram", BITS)).withColumn("less", F.greatest(F.col("n") - d, F.lit(0.0)))
    of = Window.partitionBy("context")  # at most CLASSES rows
    own = own.withColumn("all", F.sum("n").over(of)).withColumn("left", F.greatest(1 - F.sum("less").over(of) / F.col("all"), F.lit(0.0)))
    return own.select("gram", "n", (F.col("less") / F.col("all")).alias("seen"), "context", "all", "left")


class Model:
    """Kept n-grams by order: share of their context, and what each context leaves to the shorter n-gram."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], letters: Alphabet):
        """tables: (gram, seen) of orders 1, 2, ..."""
        self.orders, self.letters = [], letters
        for gram, seen in tables:
            at = np.argsort(gram)
            gram, seen = gram[at], seen[at]
            context, of = np.unique(gram >> BITS, return_inverse=True)
            self.orders.append((gram, seen, context, np.maximum(1 - np.bincount(of, seen, len(context)), 0)))

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 of the probability of each n-gram's last class after those before it."""
        p = np.full(len(gram), 1 / CLASSES)
        for k, (own, seen, context, left) in enumerate(self.orders, 1):
            if not len(own):
                continue
            g = gram & (1 << BITS * k) - 1
            at, of = np.minimum(np.searchsorted(own, g), len(own) - 1), np.minimum(np.searchsorted(context, g >> BITS), len(context) - 1)
            p = np.where(own[at] == g, seen[at], 0) + np.where(context[of] == g >> BITS, left[of], 1) * p
        return np.log10(np.maximum(p, LEAST))

    def perplexities(self, texts: list[str]) -> list[float | None]:
        """Perplexity by character of each text; None for an empty one. Each different n-gram is looked up once."""
        gram, sizes = grams(texts, self.letters)
        if not len(gram):
            return [None] * len(texts)
        each, at = np.unique(gram, return_inverse=True)
        logs = np.concatenate([[0.0], np.cumsum(self.log10(each)[at])])
        ends = np.cumsum(sizes)
        return [float(10 ** -((logs[b] - logs[b - n]) / len(t))) if n else None for b, n, t in zip(ends.tolist(), sizes.tolist(), texts)]


def _counts(docs: DataFrame, labels: DataFrame, letters: Alphabet) -> list[DataFrame]:
    """(gram, n) of all trusted text by order, from 1 on: how often the longest ones occur, and how many different classes precede the shorter ones."""
    # the same plan at every size: labels grow with the documents
    text = docs.select("doc_id", "text").join(trusted(labels).hint("merge"), "doc_id", "left_semi")
    counts = [materialize(gram_counts(text, letters), "quality-counts")]
    for order in range(ORDER - 1, 0, -1):
        counts.append(materialize(counts[-1].groupBy(_shorter("gram", order).alias("gram")).agg(F.count("*").alias("n")), "quality-counts"))
    return counts[::-1]


def _shorter(gram: str, order: int):
    """The last classes of an n-gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << BITS * order) - 1))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A small model of all trusted text, for texts that stand alone: of each order the n-grams that are at least one in KEEP. Tables of documents are scored by full()."""
    tables, letters = [], alphabet(docs)
    for counts in _counts(docs, labels, letters):
        all_ = counts.agg(F.sum("n")).first()[0] or 0
        got = _shares(counts).where(F.col("n") * KEEP >= all_).select("gram", "seen").toPandas()
        tables.append((got["gram"].to_numpy(np.int64), got["seen"].to_numpy(float)))
    return Model(tables, letters)


# --- the whole model


@dataclass(frozen=True)
class Held:
    """The most frequent keys of a table in order, with their values; whole: these are all keys, so one that isn't here is nowhere."""

    keys: np.ndarray
    values: np.ndarray
    whole: bool

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, is it here) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at], self.keys[at] == keys


def held(table: DataFrame, key: str, value: str, n: str) -> Held:
    """At most HELD keys of a table, those with the greatest n; of equals all or none."""
    whole = table.count() <= HELD
    if not whole:
        many = table.groupBy(n).agg(F.count("*").alias("rows")).orderBy(F.desc(n)).limit(HELD).select(n, F.sum("rows").over(Window.orderBy(F.desc(n))).alias("upto"))  # a row for each count
        least = many.where(F.col("upto") <= HELD).agg(F.min(n)).first()[0]
        table = table.where(F.lit(False) if least is None else F.col(n) >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:  # bytes take a fraction of what rows take on their way
            yield pa.RecordBatch.from_arrays([pa.array([got.column(0).to_numpy().astype("<i8").tobytes()]), pa.array([got.column(1).to_numpy().astype("<f8").tobytes()])], ["keys", "values"])

    got = map_arrow(table.select(key, value), run, "keys binary, values binary").collect()
    keys, values = (np.frombuffer(b"".join(r[i] for r in got), kind) for i, kind in enumerate(("<i8", "<f8")))
    order = np.argsort(keys)
    return Held(keys[order], values[order], whole)


@dataclass(frozen=True)
class Local:
    """What a worker holds of each order from 1 on: probabilities of n-grams, and what contexts leave to shorter ones."""

    orders: list[tuple[Held, Held]]
    letters: Alphabet

    def whole(self) -> bool:
        return all(grams.whole and left.whole for grams, left in self.orders)

    def probabilities(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each n-gram's last class after those before it, whether it is known here)."""
        p, known, open_ = np.ones(len(gram)), np.zeros(len(gram), bool), np.arange(len(gram))
        for k in range(ORDER, 0, -1):
            own, left = self.orders[k - 1]
            g = gram[open_] & (1 << BITS * k) - 1
            value, here = own.find(g)
            p[open_[here]] *= value[here]
            known[open_[here]] = True
            # where an n-gram that isn't here may be elsewhere, nothing can be said
            open_, g = (open_[~here], g[~here]) if own.whole else (open_[:0], g[:0])
            value, here = left.find(g >> BITS)
            p[open_[here]] *= value[here]
            if not left.whole:
                open_ = open_[here]
        p[open_] /= CLASSES
        known[open_] = True
        return p, known

    def scores(self, texts: list[str]) -> tuple[list[float], np.ndarray, pa.ListArray]:
        """(sum of log10 of the probabilities known here, characters, other n-grams and how often they occur) of each text. Each different n-gram is looked up once."""
        gram, sizes = grams(texts, self.letters)
        each, at = np.unique(gram, return_inverse=True)
        p, known = self.probabilities(each)
        logs = np.concatenate([[0.0], np.cumsum(np.where(known, np.log10(np.maximum(p, LEAST)), 0.0)[at])])
        ends = np.cumsum(sizes)
        other = np.flatnonzero(~known[at])
        pair, n = np.unique(np.searchsorted(ends, other, "right") * len(each) + at[other], return_counts=True)
        offsets = np.searchsorted(pair, np.arange(len(texts) + 1) * len(each))
        rest = pa.StructArray.from_arrays([pa.array(each[pair % max(len(each), 1)]), pa.array(n.astype(np.int64))], ["gram", "n"])
        return [float(logs[b] - logs[b - k]) for b, k in zip(ends.tolist(), sizes.tolist())], np.fromiter(map(len, texts), np.int64, len(texts)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), rest)


@dataclass(frozen=True)
class Full:
    """The whole model: by order from 1 on, (gram, p) of every n-gram and (context, left) of every context as tables, and what of them workers hold."""

    grams: list[DataFrame]
    contexts: list[DataFrame]
    local: Local

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """(gram, p) of different n-grams, seen or not, by joins with all tables."""
        found, p = asked, F.lit(1 / CLASSES)
        for k, (own, left) in enumerate(zip(self.grams, self.contexts), 1):
            found = found.withColumn(f"g{k}", _shorter("gram", k)).withColumn(f"c{k}", F.shiftright(f"g{k}", BITS))
            found = found.join(own.select(F.col("gram").alias(f"g{k}"), F.col("p").alias(f"p{k}")), f"g{k}", "left").join(left.select(F.col("context").alias(f"c{k}"), F.col("left").alias(f"left{k}")), f"c{k}", "left")
            p = F.coalesce(f"p{k}", F.coalesce(F.col(f"left{k}"), F.lit(1.0)) * p)
        return found.select("gram", p.alias("p"))


def full(docs: DataFrame, labels: DataFrame) -> Full:
    """The model of all trusted text, every n-gram in it."""
    tables, contexts, orders, before, letters = [], [], [], None, alphabet(docs)
    for counts in _counts(docs, labels, letters):
        own, k = _shares(counts), len(tables) + 1
        shorter = F.lit(1 / CLASSES)
        if before is not None:  # an n-gram's end is an n-gram too
            own = own.withColumn("end", _shorter("gram", k - 1)).join(before.select(F.col("gram").alias("end"), F.col("p").alias("shorter")), "end")
            shorter = F.col("shorter")
        before = materialize(own.select("gram", "n", (F.col("seen") + F.col("left") * shorter).alias("p"), "context", "all", "left"), "quality-grams")
        left = materialize(before.groupBy("context").agg(F.first("all").alias("all"), F.first("left").alias("left")), "quality-contexts")
        tables.append(before.select("gram", "p"))
        contexts.append(left.select("context", "left"))
        orders.append((held(before, "gram", "p", "n"), held(left, "context", "left", "all")))
    return Full(tables, contexts, Local(orders, letters))


def scored(docs: DataFrame, model: Full, columns: list[str] | None = None) -> DataFrame:
    """(row, perplexity): rows as one struct of all columns, or of some, so that no name clashes. What a worker doesn't hold comes by a join."""
    shared, whole = docs.sparkSession.sparkContext.broadcast(model.local), model.local.whole()  # at most HELD rows of each table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                total, sizes, rest = shared.value.scores(texts)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(total, pa.float64()), pa.array(sizes), rest], ["row", "total", "size", "rest"])

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns or docs.columns)).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    made = T.StructType([packed.schema["row"], *T.StructType.fromDDL("total double, size long, rest array<struct<gram: long, n: long>>")])
    found, total = map_arrow(packed, run, made), F.col("total")
    if not whole:
        found = materialize(found.withColumn("at", F.monotonically_increasing_id()), "quality-local")
        pairs = found.select("at", F.explode("rest").alias("x")).select("at", "x.gram", "x.n")
        p = model.probabilities(pairs.select("gram").distinct())
        more = pairs.join(p, "gram").groupBy("at").agg(F.sum(F.col("n") * F.log10(F.greatest("p", F.lit(LEAST)))).alias("more"))
        found, total = found.drop("rest").join(more, "at", "left"), F.col("total") + F.coalesce("more", F.lit(0.0))
    return found.select("row", F.when(F.col("size") > 0, F.pow(F.lit(10.0), -total / F.col("size"))).alias("perplexity"))


def _length(text: str):
    return F.floor(F.log2(F.length(F.col(text)) + 1.0)).cast("int").alias("length")


def thresholds(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """(of, size, least, limit) for each language and length in scores (doc_id, lang, length, perplexity): the trusted quantiles of both, else of the language, else of all."""
    good = scores.join(trusted(labels), "doc_id", "left_semi").where("perplexity is not null")
    cut = F.percentile_approx("perplexity", [LOW, HIGH], 10000)
    both = good.groupBy(F.col("lang").alias("own"), F.col("length").alias("long")).agg(F.count("*").alias("n"), cut.alias("both_cut")).where(F.col("n") >= LEAST_TRUSTED).drop("n")
    by, all_ = good.groupBy(F.col("lang").alias("own")).agg(cut.alias("own_cut")), good.agg(cut.alias("cut"))
    found = scores.select(F.col("lang").alias("of"), F.col("length").alias("size")).distinct()
    found = found.join(both, F.col("of").eqNullSafe(F.col("own")) & F.col("size").eqNullSafe(F.col("long")), "left").drop("own", "long")
    found = found.join(by, F.col("of").eqNullSafe(F.col("own")), "left").withColumn("cut", F.coalesce("both_cut", "own_cut", all_.scalar()))
    return found.select("of", "size", F.coalesce(F.get("cut", 0) / MARGIN, F.lit(0.0)).alias("least"), F.coalesce(F.get("cut", 1) * MARGIN, F.lit(float("inf"))).alias("limit"))


def _judged(own: DataFrame, slim: DataFrame, lang: str, labels: DataFrame) -> DataFrame:
    limits = materialize(thresholds(slim, labels), "quality-limits")  # a row for each language and length
    found = own.join(limits, F.col(lang).eqNullSafe(F.col("of")) & F.col("length").eqNullSafe(F.col("size")), "left").drop("of", "size", "length")
    return found.withColumn("keep", F.coalesce(F.col("perplexity").between(F.col("least"), F.col("limit")), F.lit(False)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, perplexity, least, limit, keep) of every document. Rows are written with their perplexities, so each text is scored once."""
    own = materialize(scored(docs, full(docs, labels)), "quality-scored")
    own = own.withColumn("length", _length("row.text"))
    return _judged(own, own.select("row.doc_id", "row.lang", "length", "perplexity"), "row.lang", labels)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, perplexity, least, threshold, keep) of every document: perplexities are written once, and only they meet the thresholds."""
    own = docs.select("doc_id", "lang", _length("text"), "text")
    slim = materialize(scored(own, full(docs, labels), ["doc_id", "lang", "length"]).select("row.*", "perplexity"), "quality-scores")
    return _judged(slim, slim, "lang", labels).withColumnRenamed("limit", "threshold")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of docs."""
    return classify(docs, labels).where("keep").select("row.*")
