"""Operator 1: language-model scores of whole texts.

Words are the runs between ASCII white space, with A-Z in lower case. The
training documents are those whose crc32(doc_id as text) mod FOLDS is not
HELD_OUT; all that is learned comes from all of them and grows with them:

 - every word's count (base scores), added up over all of them;
 - how subwords follow one another: each word is encoded once and counts as
   often as it stands. Steps (two subwords before, next subword or word end) that
   are at least one in STEPS of all words are kept, so at most a few times STEPS;
   classes of subwords and how class follows class come from all steps;
 - the attention's parameters: every training text passes once through Adam in
   numpy, dealt over ROUNDS by a hash; each task of a round trains on its texts,
   and Spark averages the parameters by the words seen.

The model predicts every subword id from those before it. One head of causal
self-attention looks back at up to CONTEXT + STRIDE ids; what it gathers (the
language and manner of the text) is added to the logits with which classes follow
one another. A class's probability times the id's share of the class is the
probability of an id. This is mixed with the kept steps by absolute discounting:
what the steps leave over goes to the network, and where the word ends, by a step
or by how often words end after such a class, the network chooses among ids that
begin one. So every id of the vocabulary has a probability at every place, and
they add up to one. The gradient is that of the mixed likelihood.

A text is its subword ids and one end. Windows of CONTEXT + STRIDE ids overlap by
CONTEXT and score STRIDE ids each, so each id is scored once, in batched masked
attention.

Base scores need the count of every word. Words that are at least one in HOT of
all, so HOT words at most, go to all tasks; the others join the count table by
word, so neither is the table ever in one place nor is there a hot key.

Null and empty texts are one end. Repeated rows give repeated rows. Without
training documents all counts are 0 and the model stays as it starts. Averages
depend on how the input is split, so scores of other layouts of one table differ
slightly; base scores don't. Other columns are ignored. An empty table gives an
empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from factweave.llm.common import BATCH_ROWS, map_arrow, materialize, slices
from factweave.llm.pieces import EOS

FOLDS, HELD_OUT = 7, 2
#: Ids that are classes of their own, and classes of rare ids that begin a word; as many of those within words.
SINGLES, RARE = 352, 16
CLASSES = SINGLES + 2 * RARE
KEY, WIDTH = 8, 16
CONTEXT, STRIDE = 24, 40
BATCH, RATE = 64, 0.01
#: Places whose logits are computed together.
CHUNK = 256
#: Hash values (of SHARES) of the documents of each round; every document is in one of them.
SHARES, ROUNDS = 16, ((0, 1), (1, 5), (5, 16))
#: Words that are at least one in HOT of all: at most HOT words, whatever the corpus. Steps likewise.
HOT, STEPS = 1_000_000, 300_000
DISCOUNT = 0.85
FLUSH_WORDS, CACHE_WORDS = 400_000, 250_000
PAD = CLASSES  # no id: before a text
NONE = 0xFFFF  # no subword before, or no subword after: ids are below it

_SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare_word array<binary>, rare_n array<long>"


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial word counts of training texts; an empty word counts the ends."""
    counts: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for _, texts in slices(batch):
            for text in texts:
                counts.update(words_of(text))
            counts[b""] += len(texts)
            if len(counts) > FLUSH_WORDS:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


@lru_cache(2)
def _processor(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


@lru_cache(2)
def begins(model_path: str) -> np.ndarray:
    """Which ids begin a word; the end of a text counts as one."""
    p = _processor(model_path)
    out = np.array([p.id_to_piece(i).startswith("▁") for i in range(p.get_piece_size())])
    out[EOS] = True
    return out


def _ids(model_path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of words, each with a space before it, in one array; and how many each has."""
    lists = _processor(model_path).encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _encoded(counts: DataFrame, model_path: str) -> DataFrame:
    """(ids, sizes, n) of the words of each batch, as arrays in binary: each word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(words: list[bytes], n: list[int]) -> pa.RecordBatch:
            ids, sizes = _ids(model_path, words)
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids.astype("<u2"), sizes.astype("<i4"), np.array(n, "<i8"))], ["ids", "sizes", "n"])

        words, n = [], []
        for batch in batches:
            words += batch.column("word").to_pylist()
            n += batch.column("n").to_pylist()
            if len(words) >= 16 * BATCH_ROWS:
                yield done(words, n)
                words, n = [], []
        if words:
            yield done(words, n)

    return materialize(map_arrow(counts.where(F.col("word") != b""), run, "ids binary, sizes binary, n binary"), "lm-encoded")


def steps_of(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps after each id of words in one array, as (two ids before) << 16 | next; and where words begin. NONE stands before and after a word."""
    starts = np.cumsum(sizes) - sizes
    first = np.zeros(len(ids), bool)
    first[starts[sizes > 0]] = True
    before = np.where(first, NONE, np.r_[NONE, ids[:-1]] if len(ids) else ids)
    last = np.r_[first[1:], True] if len(ids) else first
    after = np.where(last, NONE, np.r_[ids[1:], NONE] if len(ids) else ids)
    return before << 32 | ids << 16 | after, first


def _step_counts(encoded: DataFrame) -> DataFrame:
    """(step, n): how often each step is taken in all words; a step of -1 - id counts the words that begin with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        for batch in batches:
            for ids, sizes, n in zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "n"))):
                ids, sizes, n = np.frombuffer(ids, "<u2").astype(np.int64), np.frombuffer(sizes, "<i4"), np.frombuffer(n, "<i8")
                step, first = steps_of(ids, sizes)
                held.append((np.r_[step, -1 - ids[first]], np.r_[np.repeat(n, sizes), n[sizes > 0]]))
                if len(held) == 64:
                    held = [added()]
                    if len(held[0][0]) > FLUSH_WORDS:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["step", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in added()], ["step", "n"])

    return materialize(map_arrow(encoded, run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")), "lm-steps")


def _id_counts(steps: DataFrame, size: int) -> np.ndarray:
    """How often each id stands: each is the middle of one step."""
    got = steps.where("step >= 0").groupBy(F.shiftright("step", 16).bitwiseAND(F.lit(0xFFFF)).alias("id")).agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    out = np.zeros(size, np.int64)
    out[got["id"].to_numpy(np.int64)] = got["n"].to_numpy()
    return out


class Vocabulary:
    """Ids to classes and each id's share of its class. Classes of ids that begin a word (an end counts as one) come first, `begun` of them, then those of ids within words."""

    def __init__(self, n: np.ndarray, start: np.ndarray):
        smooth = n.astype(np.float64) + 0.1
        order = np.argsort(-smooth, kind="stable")
        order = np.concatenate([[EOS], order[order != EOS]])
        single = np.zeros(len(n), bool)
        single[order[:SINGLES]] = True
        self.of, at = np.empty(len(n), np.uint16), 0
        for side in (start, ~start):
            own = order[side[order] & single[order]]
            self.of[own] = at + np.arange(len(own))
            rest = order[side[order] & ~single[order]]
            # rare classes of about the same weight
            self.of[rest] = at + len(own) + np.minimum((np.cumsum(smooth[rest]) / max(smooth[rest].sum(), 1e-9) * RARE).astype(int), RARE - 1)
            at += len(own) + RARE
            if side is start:
                self.begun = at
        weight = np.bincount(self.of, smooth, CLASSES)
        self.share = (smooth / weight[self.of]).astype(np.float32)
        self.weight = np.maximum(weight, 1e-9)
        self.end = int(self.of[EOS])


class Steps:
    """Kept steps by absolute discounting: the share of each after its two subwords, and what those leave to the network."""

    def __init__(self, step: np.ndarray, n: np.ndarray, total: np.ndarray):
        order = np.argsort(step)
        self.step, own = step[order], np.maximum(n[order] - DISCOUNT, 0) / total[order]
        self.own = own.astype(np.float32)
        self.context, at = np.unique(self.step >> 16, return_inverse=True)
        self.left = np.maximum(1 - np.bincount(at, own, len(self.context)), 0).astype(np.float32)

    def of(self, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share, left) of steps; where nothing is kept, all is left."""
        if not len(self.step):
            return np.zeros(len(step), np.float32), np.ones(len(step), np.float32)
        at = np.minimum(np.searchsorted(self.step, step), len(self.step) - 1)
        context = step >> 16
        of = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        return np.where(self.step[at] == step, self.own[at], 0), np.where(self.context[of] == context, self.left[of], 1)


def _kept(steps: DataFrame, words: int) -> Steps:
    """Steps that are at least one in STEPS of all words: as many as STEPS times the subwords of a word, at most."""
    real = steps.where("step >= 0").withColumn("context", F.shiftright("step", 16))
    total = real.groupBy("context").agg(F.sum("n").alias("total"))
    got = real.where(F.col("n") * STEPS >= words).join(total, "context").select("step", "n", "total").toPandas()
    return Steps(*(got[c].to_numpy(np.int64) for c in ("step", "n", "total")))


def _followers(steps: DataFrame, vocabulary: Vocabulary, ends: int) -> np.ndarray:
    """How often each class follows each, over all steps: ends of words meet beginnings by chance."""
    spark = steps.sparkSession
    of = spark.createDataFrame([(i, int(c)) for i, c in enumerate(vocabulary.of)], "id int, class int")  # the vocabulary
    part = lambda shift: F.shiftright("step", shift).bitwiseAND(F.lit(0xFFFF)).cast("int")
    real = steps.where("step >= 0").select(part(16).alias("a"), part(0).alias("b"), "n")
    begun = steps.where("step < 0").select(F.lit(NONE).alias("a"), (-1 - F.col("step")).cast("int").alias("b"), "n")
    named = real.unionByName(begun).groupBy("a", "b").agg(F.sum("n").alias("n"))
    for c in ("a", "b"):
        named = named.join(F.broadcast(of.withColumnsRenamed({"id": c, "class": f"c{c}"})), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", F.lit(CLASSES)))
    got = named.groupBy("ca", "cb").agg(F.sum("n").alias("n")).toPandas()  # at most the square of the classes
    table = np.zeros((CLASSES + 1, CLASSES + 1))
    table[got["ca"].to_numpy(), got["cb"].to_numpy()] = got["n"].to_numpy()
    first = table[CLASSES, :CLASSES].copy()
    first[vocabulary.end] += ends
    return table[:CLASSES, :CLASSES] + np.outer(table[:CLASSES, CLASSES], first) / max(1.0, first.sum())


_LENGTH = CONTEXT + STRIDE
_DISTANCE = CONTEXT + np.arange(STRIDE)[:, None] - np.arange(_LENGTH)[None, :]
SHAPES = {"query": (CLASSES + 1, KEY), "key": (CLASSES + 1, KEY), "value": (CLASSES + 1, WIDTH), "out": (WIDTH, CLASSES), "near": (_LENGTH,)}


def start(vocabulary: Vocabulary, followers: np.ndarray) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """First parameters, and what stays: the logits with which classes follow one another (rows: the class before, PAD last), and how often a word ends after each."""
    rng = np.random.default_rng(7)
    p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in SHAPES.items()}
    p["near"] = (-0.02 * np.arange(_LENGTH)).astype(np.float32)
    share = vocabulary.weight / vocabulary.weight.sum()
    rows = np.vstack([(followers + 20 * share) / (followers.sum(1, keepdims=True) + 20), share])
    return p, (np.log(rows).astype(np.float32), rows[:, : vocabulary.begun].sum(1).astype(np.float32))


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, at, text) of texts of so many ids, one after another: places of the inputs and targets of each window, and its text.

    Inputs are -1 for the end before a text and -2 before that; targets beyond a text are -1.
    """
    starts = np.cumsum(sizes) - sizes
    count = -(-sizes // STRIDE)
    text = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = nth[:, None] * STRIDE + np.arange(STRIDE)
    target = np.where(at < sizes[text][:, None], starts[text][:, None] + at, -1)
    before = nth[:, None] * STRIDE - CONTEXT - 1 + np.arange(_LENGTH)
    source = np.where(before >= 0, np.minimum(starts[text][:, None] + before, starts[text][:, None] + sizes[text][:, None] - 1), np.where(before == -1, -1, -2))
    return source, target, text


class Tokens:
    """The ids of texts, one after another: their class, share of it, step's share and what it leaves, and whether they begin a word."""

    def __init__(self, kind: np.ndarray, share: np.ndarray, own: np.ndarray, left: np.ndarray, begins: np.ndarray, sizes: np.ndarray, end: int):
        self.kind, self.share, self.own, self.left, self.begins, self.sizes, self.end = kind, share, own, left, begins, sizes, end

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, places of targets, text of each window)."""
        source, target, text = windows(self.sizes)
        x = np.where(source >= 0, self.kind[np.maximum(source, 0)], np.where(source == -1, self.end, PAD))
        return x, target, text


class Net:
    """The mixed model: likelihoods of targets, and gradients of their mean.

    After an id, a kept step or what the steps leave says whether the word ends;
    then the network chooses among the classes that begin a word. Within a word it
    chooses among the others, as far as the steps leave room. So each target needs
    the logits of its own side only.
    """

    def __init__(self, p: dict[str, np.ndarray], fixed: tuple[np.ndarray, np.ndarray], begun: int):
        self.p, self.ends = p, fixed[1]
        self.sides = (slice(begun, CLASSES), slice(0, begun))  # within words, at their beginning
        self.rows = [np.ascontiguousarray(fixed[0][:, side]) for side in self.sides]
        # fresh arrays of this size would cost more than the arithmetic
        self.space = [np.empty((2, CHUNK, side.stop - side.start), np.float32) for side in self.sides]
        self.ones = [np.ones(side.stop - side.start, np.float32) for side in self.sides]
        self.high = [float(rows.max()) for rows in self.rows]

    def _longest(self, name: str, axis: int) -> float:
        """The greatest norm of a parameter's rows or columns: products with them are bounded by it."""
        return float(np.sqrt(np.square(self.p[name]).sum(axis).max()))

    def _attend(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.p
        near = np.where(_DISTANCE >= 0, np.exp(p["near"])[np.maximum(_DISTANCE, 0)], 0).astype(np.float32)
        value = np.concatenate([p["value"], np.ones((CLASSES + 1, 1), np.float32)], axis=1)
        value[PAD] = 0  # padding has neither value nor weight
        q, k, v = p["query"][x[:, CONTEXT:]] * np.float32(KEY**-0.5), p["key"][x], value[x]
        w = np.matmul(q, np.ascontiguousarray(k.transpose(0, 2, 1)))
        if not self._longest("query", 1) * self._longest("key", 1) * KEY**-0.5 < 60:  # else no weight is that large
            np.minimum(w, 60, out=w)
        np.exp(w, out=w)
        w *= near
        h = np.matmul(w, v)
        all_ = np.maximum(h[..., WIDTH:], np.float32(1e-30))
        return q, k, v, w, all_, np.ascontiguousarray(h[..., :WIDTH] / all_).reshape(-1, WIDTH)

    def _mixed(self, side: int, out: np.ndarray, cut: bool, before: np.ndarray, h: np.ndarray, t: Tokens, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of at most CHUNK targets of one side: exponentials of its logits (cut at 60 if any may be larger), their sums, what the network gives the target, and what the steps do."""
        n, space = len(at), self.space[side]
        e = np.dot(h, out, out=space[0, :n])
        e += np.take(self.rows[side], before, axis=0, out=space[1, :n], mode="clip")
        if cut:
            np.minimum(e, 60, out=e)
        np.exp(e, out=e)
        z = e @ self.ones[side]
        net = e[np.arange(n), t.kind[at] - self.sides[side].start] * t.share[at] / z
        own, left = t.own[at], t.left[at]
        if side:
            return e, z, net * (own + left * self.ends[before]), np.float32(0)
        return e, z, net * left * (1 - self.ends[before]), own

    def _each(self, x: np.ndarray, h: np.ndarray, t: Tokens, target: np.ndarray) -> Iterator[tuple]:
        """(side, output of the side, places, results of _mixed) in parts that stay in a core's cache."""
        before, begins = x[:, CONTEXT:].ravel(), t.begins[np.maximum(target, 0)]
        product = self._longest("value", 1) * self._longest("out", 0)  # what is gathered is a mean of values
        for side in (0, 1):
            out, cut = np.ascontiguousarray(self.p["out"][:, self.sides[side]]), not product + self.high[side] < 60
            places = np.flatnonzero((begins == side) & (target >= 0))
            for a in range(0, len(places), CHUNK):
                part = places[a : a + CHUNK]
                yield side, out, part, self._mixed(side, out, cut, before[part], h[part], t, target[part])

    def likelihoods(self, t: Tokens, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 of each target's probability, 0 beyond texts."""
        out = np.zeros(at.size)
        for a in range(0, len(x), BATCH):
            part, target = x[a : a + BATCH], at[a : a + BATCH].ravel()
            for _, _, places, (_, _, net, own) in self._each(part, self._attend(part)[-1], t, target):
                out[a * STRIDE + places] = np.log10(np.maximum(net + own, 1e-37))
        return out.reshape(at.shape)

    def gradients(self, t: Tokens, x: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of a batch."""
        q, k, v, w, all_, h = self._attend(x)
        target = target.ravel()
        count = np.float32(max(1, (target >= 0).sum()))
        dh, dout = np.zeros_like(h), np.zeros((WIDTH, CLASSES), np.float32)
        # what scales whole rows of e and w is put on the narrow arrays that they are multiplied with
        for side, out, places, (e, z, net, own) in self._each(x, h, t, target):
            scale = (net / (np.maximum(net + own, np.float32(1e-37)) * count) / z)[:, None]
            e[np.arange(len(places)), t.kind[target[places]] - self.sides[side].start] -= z
            dh[places] = (e @ out.T) * scale
            dout[:, self.sides[side]] += (h[places] * scale).T @ e
        dh = dh.reshape(len(x), STRIDE, WIDTH)
        dh /= all_
        padded = np.flatnonzero((x == PAD).any(1))
        w[padded] *= (x[padded] != PAD)[:, None, :]
        da = np.matmul(np.concatenate([dh, -(dh * h.reshape(dh.shape)).sum(2, keepdims=True)], axis=2), np.ascontiguousarray(v.transpose(0, 2, 1)))  # the last column of v is 1
        da *= w
        dq, dk, dv = np.matmul(da, k) * np.float32(KEY**-0.5), np.matmul(da.transpose(0, 2, 1), q), np.matmul(w.transpose(0, 2, 1), dh)
        near = np.bincount(np.maximum(_DISTANCE, 0).ravel(), np.where(_DISTANCE >= 0, da.sum(0), 0).ravel(), _LENGTH)
        add = lambda kind, d, n: np.bincount((kind[..., None] * n + np.arange(n)).ravel(), d.ravel(), (CLASSES + 1) * n).reshape(-1, n)
        return {"query": add(x[:, CONTEXT:], dq, KEY), "key": add(x, dk, KEY), "value": add(x, dv, WIDTH), "out": dout, "near": near}

    def train(self, t: Tokens, state: dict, rate: float = RATE) -> None:
        """One Adam step for each batch of windows, in place."""
        x, at, _ = t.windows()
        for a in range(0, len(x), BATCH):
            state["t"] = n = state.get("t", 0) + 1
            for name, g in self.gradients(t, x[a : a + BATCH], at[a : a + BATCH]).items():
                m, v = state.setdefault(name, [np.zeros(g.shape), np.zeros(g.shape)])
                m += 0.1 * (g - m)
                v += 0.005 * (g * g - v)
                self.p[name] -= (rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.995**n)) + 1e-8)).astype(np.float32)


class Book:
    """What a task remembers of words: ids, steps, and log10 of count + 1 (rare words: none). Hot words come first and stay."""

    def __init__(self, vocabulary: Vocabulary, steps: Steps, hot: dict[bytes, int], model_path: str):
        self.vocabulary, self.steps, self.hot, self.model_path = vocabulary, steps, hot, model_path
        self.begins = begins(model_path)
        self.words: list[bytes] = []
        self.ids, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.own, self.left, self.base = np.zeros(0, np.float32), np.zeros(0, np.float32), np.zeros(0)
        self.place: dict[bytes, int] = {}
        self.add(list(hot))
        self.kept, self.hot_place = len(hot), dict(self.place)

    def add(self, words: list[bytes]) -> None:
        """Words that are not known yet are encoded together."""
        ids, sizes = _ids(self.model_path, words)
        own, left = self.steps.of(steps_of(ids, sizes)[0])
        self.place.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.words += words
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.own, self.left = np.concatenate([self.own, own]), np.concatenate([self.left, left])
        self.base = np.concatenate([self.base, np.log10(np.array([self.hot.get(w, np.nan) for w in words]) + 1.0)])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def forget(self) -> None:
        """Only the hot words stay."""
        k = self.kept
        n = int(self.sizes[:k].sum())
        self.place, self.words = dict(self.hot_place), self.words[:k]
        self.ids, self.own, self.left, self.sizes, self.base = self.ids[:n], self.own[:n], self.left[:n], self.sizes[:k], self.base[:k]

    def places(self, words: list[bytes]) -> np.ndarray:
        """Places of words; when there would be too many, those that aren't hot are forgotten first."""
        for _ in range(2):
            at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
            unknown = np.flatnonzero(at < 0).tolist()
            missing = list({words[i] for i in unknown})
            if len(self.words) + len(missing) <= CACHE_WORDS + self.kept or len(self.words) == self.kept:
                break
            self.forget()
        if missing:
            self.add(missing)
            at[unknown] = [self.place[words[i]] for i in unknown]
        return at

    def tokens(self, at: np.ndarray, n_words: np.ndarray) -> Tokens:
        """The ids of texts of so many words at these places, each text followed by its end."""
        vocabulary, sizes, doc = self.vocabulary, self.sizes[at], np.repeat(np.arange(len(n_words)), n_words)
        length = np.bincount(doc, sizes, len(n_words)).astype(np.int64) + 1
        where = np.arange(sizes.sum()) + np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes) if len(at) else np.zeros(0, np.int64)
        ends = np.cumsum(length)
        inner = np.ones(int(ends[-1]) if len(ends) else 0, bool)
        inner[ends - 1] = False
        ids = np.full(len(inner), EOS)
        ids[inner] = self.ids[where]
        # a step stands at the id before it; the first id of a text follows an end for certain
        own, left = np.ones(len(ids), np.float32), np.zeros(len(ids), np.float32)
        own[inner], left[inner] = self.own[where], self.left[where]
        own, left = np.r_[np.float32(1), own[:-1]], np.r_[np.float32(0), left[:-1]]
        first = np.zeros(len(ids), bool)
        first[ends - 1] = True
        if len(sizes):
            begun = np.cumsum(sizes) - sizes + doc  # ends of earlier texts stand between
            first[begun[sizes > 0]] = True
        return Tokens(vocabulary.of[ids].astype(np.int64), vocabulary.share[ids], own, left, first & self.begins[ids], length, vocabulary.end)


def _round(docs: DataFrame, p: dict[str, np.ndarray], fixed: tuple, rate: float) -> dict[str, np.ndarray]:
    """One round: each task trains on its texts, and the parameters are averaged by the windows that they have seen."""
    shared = docs.sparkSession.sparkContext.broadcast((p, *fixed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, state, seen = None, {}, 0
        for batch in batches:
            for _, texts in slices(batch):
                if net is None:
                    own, rows, vocabulary, steps, hot, model_path = shared.value
                    net, book = Net({k: v.copy() for k, v in own.items()}, rows, vocabulary.begun), Book(vocabulary, steps, hot, model_path)
                split = [words_of(t) for t in texts]
                tokens = book.tokens(book.places(list(chain.from_iterable(split))), np.array(list(map(len, split))))
                net.train(tokens, state, rate)
                seen += int(tokens.sizes.sum())
        if seen:
            value = np.concatenate([net.p[k].ravel() for k in SHAPES]).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value) + 1)), pa.array(np.append(value, seen))], ["i", "v"])

    got = map_arrow(docs, run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # the parameters
    if not len(got):
        return p
    flat = got.sort_values("i")["v"].to_numpy()
    flat, out, at = flat[:-1] / flat[-1], {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name], at = flat[at : at + n].reshape(shape).astype(np.float32), at + n
    return out


class Scorer:
    """Scores texts with the model and the counts of hot words."""

    def __init__(self, p: dict, rows: tuple, vocabulary: Vocabulary, steps: Steps, hot: dict[bytes, int], model_path: str, ends: int, total: int, distinct: int):
        self.net, self.book = Net(p, rows, vocabulary.begun), Book(vocabulary, steps, hot, model_path)
        self.unit = float(np.log10(total + 1.0 * (distinct + 1)))
        self.end, self.known_end = float(np.log10(ends + 1.0)) - self.unit, int(ends > 0)

    def texts(self, texts: list[str]) -> list[tuple]:
        """(n_tokens, n_known, base_score, score, rare words, their counts) of each text; rare words are not in n_known and base_score."""
        split, book = [words_of(t) for t in texts], self.book
        n_docs, n_words = len(texts), np.array(list(map(len, split)))
        doc = np.repeat(np.arange(n_docs), n_words)
        at = book.places(list(chain.from_iterable(split)))
        base = book.base[at] - self.unit
        rare = np.isnan(base)
        known = n_words - np.bincount(doc[rare], minlength=n_docs) + self.known_end
        scores = np.bincount(doc, np.where(rare, 0, base), n_docs) + self.end
        few, times = np.unique(doc[rare] * len(book.words) + at[rare], return_counts=True)
        cut = np.searchsorted(few // max(1, len(book.words)), np.arange(n_docs + 1))
        names, times = [book.words[i] for i in (few % max(1, len(book.words))).tolist()], times.tolist()
        tokens = book.tokens(at, n_words)
        x, target, text = tokens.windows()
        score = np.bincount(text, self.net.likelihoods(tokens, x, target).sum(1), n_docs)
        return [(n + 1, k, b, s, names[i:j], times[i:j]) for n, k, b, s, i, j in zip(n_words.tolist(), known.tolist(), scores.tolist(), score.tolist(), cut, cut[1:])]


def score(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    training = docs.where(~F.col("held_out")).select("doc_id", "text")
    counts = materialize(map_arrow(training, _gather, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == b"", F.col("n"))).alias("ends")).first()
    n, v, ends = total["n"] or 0, total["v"], total["ends"] or 0
    steps = _step_counts(_encoded(counts, model_path))
    n_ids = _id_counts(steps, _processor(model_path).get_piece_size())
    n_ids[EOS] += ends
    vocabulary = Vocabulary(n_ids, begins(model_path))
    p, rows = start(vocabulary, _followers(steps, vocabulary, ends))
    hot = {bytes(r["word"]): r["n"] for r in counts.where((F.col("word") != b"") & (F.col("n") * HOT >= n)).collect()}
    fixed = (rows, vocabulary, _kept(steps, n), hot, model_path)
    deal = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))
    for first, last in ROUNDS:
        p = _round(training.where(deal.between(first, last - 1)), p, fixed, RATE)
    shared = spark.sparkContext.broadcast((p, *fixed, ends, n, v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, scorer = TaskContext.get().partitionId() << 33, None
        for batch in batches:
            for part, texts in slices(batch):
                scorer = scorer or Scorer(*shared.value)
                cols = list(zip(*scorer.texts(texts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + len(texts))), part.column("doc_id"), part.column("held_out"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))))],
                    ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare_word", "rare_n"],
                )
                rid += len(texts)

    own = materialize(map_arrow(docs, run, _SCORED), "lm-scored")
    unit = float(np.log10(n + 1.0 * (v + 1)))
    rare = own.select("rid", F.explode(F.arrays_zip("rare_word", "rare_n")).alias("x")).select("rid", F.col("x.rare_word").alias("word"), F.col("x.rare_n").alias("times"))
    seen = rare.join(counts, "word", "left").select("rid", "times", F.coalesce("n", F.lit(0)).alias("n"))
    sums = seen.groupBy("rid").agg(F.sum(F.col("times") * (F.log10(F.col("n") + 1.0) - unit)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    zero = F.lit(0)
    return own.drop("rare_word", "rare_n").join(sums, "rid", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more", zero)).alias("base_score"), "score")
