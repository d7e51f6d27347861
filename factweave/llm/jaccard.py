"""Operator 2: the n-gram Jaccard join: groups of documents linked by their word shingles.

Exact at every size, in four steps:
 1. One pass over the texts makes each document's sorted array of distinct
    shingle hashes (64 bits), a digest of it, and its prefix: by the pigeonhole
    principle two sets at or above the threshold share one of the first
    n - ceil(t n) + 1 shingles in any one order of all shingles. The order
    puts shingles last that are frequent in a sample; that changes the cost
    only, never the result. Equal sets become one class.
 2. Classes that share a prefix shingle meet, in order of size. Bitmap signatures
    (a bit is the parity of the shingles that hash to it) bound each pair's
    overlap from above, and pairs that may link are joined into coarse groups.
 3. A coarse group is cut into tiles of about TILE classes. Within a tile,
    classes are ordered by size, so partners lie in a band of sizes; bitmap
    signatures bound the overlap from above by their differing bits, and what
    is left is counted exactly on the arrays. Pairs already connected are
    passed over: groups stay whole, and copies never become all pairs. Large
    groups first meet HUBS of their own in every tile; then only classes
    outside the group's main component meet the others.
 4. Components of the links.

A null or empty text has no shingles, n_shingles 0, and is linked with nothing,
so its component is its own id. Fewer words than k make one shingle. Rows that
share a doc_id are one document when links are followed, and each keeps its
n_shingles. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from factweave.llm.common import documents_text, map_arrow, materialize, slices
from factweave.llm.components import components
from factweave.scratch import drop

#: Classes of a tile, and hubs that each tile of a larger group meets. Above SPLIT classes of one shingle, its classes are dealt out too.
TILE, HUBS, SPLIT = 128, 48, 1024
#: Documents of the sample that orders shingles, and how many frequent ones are told apart.
ORDER_SAMPLE, ORDER_SHINGLES = 4096, 50_000
CACHE_WORDS = 300_000

SETS = "doc_id long, n_shingles long, digest binary, signature binary, prefix array<long>"
#: Groups of classes that share a shingle are compared in whole arrays up to this size, and class by class above.
SMALL = 32
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes; hashes of words are remembered."""

    def __init__(self, k: int):
        self.k, self.cache = k, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        try:
            h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in cache:
                    cache[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - k + 1, k, np.uint64)
            for i in range(k):
                out = (out ^ h[i : len(h) - k + 1 + i]) * _MULT[i % len(_MULT)]
                out ^= out >> np.uint64(32)
            out *= _MULT[1]
            out ^= out >> np.uint64(29)
        return np.unique(out)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def signature(a: np.ndarray) -> np.ndarray:
    """Parities of a set's hashes on the least power of two of bits, 64 or more, that is at least its size."""
    bits = max(64, 1 << (len(a) - 1).bit_length())
    return np.packbits((np.bincount((a & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def frequent_shingles(docs: DataFrame, k: int, sample: int = ORDER_SAMPLE, keep: int = ORDER_SHINGLES) -> np.ndarray:
    """At most `keep` shingles that stand in 3 or more documents of a sample of about `sample`. They order the prefixes only."""
    rows = docs.count()
    every = max(1, rows // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(k)
        for batch in batches:
            for _, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *map(shingle, texts)]).view(np.int64))], ["h"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    found = map_arrow(some, run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "h").limit(keep)
    return np.sort(np.array([r["h"] for r in found.collect()], np.int64).view(np.uint64))


def shingle_sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, digest, prefix) of every document."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k))

    def prefix(a: np.ndarray) -> np.ndarray:
        p, late = prefix_length(len(a), num, den), frequent.value
        if not len(late):
            return a[:p]
        at, rare, held = 0, [], []
        while p > 0 and at < len(a):
            part = a[at : at + 2 * p + 8]
            is_late = late[np.minimum(np.searchsorted(late, part), len(late) - 1)] == part
            got = part[~is_late][:p]
            rare.append(got)
            held.append(part[is_late])
            p, at = p - len(got), at + len(part)
        return np.concatenate([*rare, *([np.concatenate(held)[:p]] if p > 0 else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(k)
        for batch in batches:
            for part, texts in slices(batch):
                sets = [shingle(t) for t in texts]
                digests = [hashlib.blake2b(a.tobytes(), digest_size=16).digest() for a in sets]
                prefixes = [prefix(a).view(np.int64) if len(a) else np.zeros(0, np.int64) for a in sets]
                signatures = [signature(a).tobytes() if len(a) else b"" for a in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(a) for a in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), lists], ["doc_id", "n_shingles", "digest", "signature", "prefix"])

    return map_arrow(docs, run, SETS)


class Group:
    """Rows (token, id, n, signature) in order of token and size."""

    def __init__(self, token: np.ndarray, ids: np.ndarray, n: np.ndarray, signatures: list[bytes]):
        self.token, self.ids, self.n = token, ids, n
        self.words = np.array([len(x) // 8 for x in signatures], np.int64)
        width = int(self.words.max())
        self.full = np.frombuffer(b"".join(x.ljust(width * 8, b"\0") for x in signatures), np.uint64).reshape(len(ids), width)
        # a signature of half the bits is the two halves, one upon the other
        self.half = np.zeros_like(self.full)
        for w in np.unique(self.words[self.words > 1]).tolist():
            rows = np.flatnonzero(self.words == w)
            self.half[rows, : w // 2] = self.full[rows, : w // 2] ^ self.full[rows, w // 2 : w]

    def may_link(self, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        """Of pairs of rows, n[i] <= n[j]: whether sizes and differing bits leave room for a link."""
        ok = num * self.n[j] <= den * self.n[i]
        i, j = i[ok], j[ok]
        other = np.where((self.words[j] > self.words[i])[:, None], self.half[j], self.full[j])
        both = self.n[i] + self.n[j]
        differ = np.bitwise_count(self.full[i] ^ other).sum(axis=1, dtype=np.int64)
        ok[ok] = ((both - differ) // 2) * (num + den) >= num * both
        return ok

    def candidates(self, num: int, den: int, label: np.ndarray | None = None, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pairs that may link and connect all that may: every pair of small groups, a spanning forest of large ones.

        Rows of one label are connected already, and two that aren't active needn't meet.
        """
        begin = np.flatnonzero(np.r_[True, self.token[1:] != self.token[:-1]])
        size = np.diff(np.r_[begin, len(self.token)])
        end = np.repeat(begin + size, size)
        small = np.flatnonzero(np.repeat(size <= SMALL, size))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for lag in range(1, int(min(SMALL, size.max()))):
            i = small[small + lag < end[small]]
            if not len(i):
                break
            ok = self.may_link(i, i + lag, num, den)
            out.append((self.ids[i[ok]], self.ids[i[ok] + lag]))
        for b, m in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist()):
            root = np.arange(m) if label is None else np.unique(label[b : b + m], return_inverse=True)[1]
            lasts = np.searchsorted(self.n[b : b + m], self.n[b : b + m] * den // num, "right")  # the band: sizes up to den / num times this one
            for i in range(m):
                j = i + 1 + np.flatnonzero(root[i + 1 : lasts[i]] != root[i])
                if active is not None and not active[b + i]:
                    j = j[active[b + j]]
                j = j[self.may_link(np.full(len(j), b + i), b + j, num, den)]
                if len(j):
                    first = j[np.unique(root[j], return_index=True)[1]]  # one of each component
                    out.append((np.full(len(first), self.ids[b + i]), self.ids[b + first]))
                    root[np.isin(root, root[j])] = root[i]
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def met(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of rows (token, id, n, signature, label, active) that share a token and may link, as far as they connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> pa.RecordBatch:
            g = Group(*(table.column(c).to_numpy() for c in ("token", "id", "n")), table.column("signature").to_pylist())
            a, b = g.candidates(num, den, *(table.column(c).to_numpy() for c in ("label", "active")))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:  # a token's rows stand together, maybe over several batches
            token = batch.column("token").to_numpy()
            cut = len(token) - int((token == token[-1]).sum())
            if cut or (held and held[-1].column("token")[0].as_py() != token[0]):
                yield done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield done(pa.Table.from_batches(held))

    dealt = rows.repartition("token").sortWithinPartitions("token", "n", "id")
    return map_arrow(dealt, run, "a long, b long")


def candidates(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of rows (token, many, id, n, signature) that share a token, which `many` rows have, and may link, as far as they connect.

    Rows of a token that more than SPLIT have are dealt by bands of sizes, each
    band together with the next, so that all that may link still meet; and a band
    is dealt into blocks as coarse groups are: hubs in every block first, then
    what they don't connect, block by block. So no task holds a whole token.
    """
    cols = ["token", "id", "n", "signature", "label", "active"]
    plain = rows.where(F.col("many") <= SPLIT).select("token", "id", "n", "signature", F.col("id").alias("label"), F.lit(True).alias("active"))
    few = met(plain, num, den)
    band = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * math.log(den / num)))
    hot = rows.where(F.col("many") > SPLIT).withColumn("band", F.explode(F.array(band, band - 1))).select(F.xxhash64("token", "band").alias("coarse"), "id", F.col("n").alias("size"), "signature")
    hot = materialize(hot, "jaccard-hot")
    if hot.isEmpty():
        return few.distinct()
    members = materialize(hot.join(hot.groupBy("coarse").agg(F.count("*").alias("n")), "coarse"), "jaccard-hot")
    tile = F.xxhash64("coarse", "i", "j").alias("token")
    dealt = lambda t: met(t.select(tile, "id", F.col("size").alias("n"), "signature", "label", "active").select(*cols), num, den)
    one = materialize(few.unionByName(dealt(_first_tiles(members, ["size", "signature"], SPLIT))).distinct(), "jaccard-pairs")
    two = dealt(_rest_tiles(members, components(one), ["size", "signature"], SPLIT))
    return one.unionByName(two).distinct()


def linked(ids: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, active: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect a tile's labels: a spanning forest over all links of active sets with any, found by bitmaps and then exactly."""
    order = np.argsort([len(a) for a in sets], kind="stable")
    ids, labels, active, sets = ids[order], labels[order], active[order], [sets[i] for i in order]
    size = np.array([len(a) for a in sets], np.int64)
    flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    start = np.cumsum(size) - size
    bits = 1 << int(np.clip(np.ceil(np.log2(2 * np.median(size) + 1)), 6, 13))
    at = own * bits + (flat & np.uint64(bits - 1)).astype(np.int64)
    # a bit is the parity of the shingles that fall on it, so differing bits count shingles that the sets don't share
    signature = np.packbits((np.bincount(at, minlength=len(sets) * bits) & 1).astype(np.uint8).reshape(len(sets), bits), axis=1).view(np.uint64)
    local = np.unique(flat, return_inverse=True)[1]
    mark = np.zeros(int(local.max()) + 1, bool)
    root = np.unique(labels, return_inverse=True)[1]
    out = []
    for i in range(len(sets)):
        last = np.searchsorted(size, size[i] * den // num, "right")  # the band: sizes up to den / num times this one
        j = np.arange(i + 1, last)
        j = j[(root[j] != root[i]) & (active[j] | active[i])]
        if not len(j):
            continue
        both = size[i] + size[j]
        bound = (both - np.bitwise_count(signature[j] ^ signature[i]).sum(axis=1, dtype=np.int64)) // 2
        j = j[bound * (num + den) >= num * both]
        if not len(j):
            continue
        mark[local[start[i] : start[i] + size[i]]] = True
        n = size[j]
        first = np.cumsum(n) - n
        where = np.arange(n.sum()) + np.repeat(start[j] - first, n)
        overlap = np.add.reduceat(mark[local[where]].astype(np.int64), first)
        mark[local[start[i] : start[i] + size[i]]] = False
        for x in j[overlap * (num + den) >= num * (size[i] + n)].tolist():
            if root[x] != root[i]:
                out.append((int(ids[i]), int(ids[x])))
                root[root == root[x]] = root[i]
    return out


def verified(tiles: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) within tiles (tile..., id, label, active, text)."""

    def run(batch: pa.Table) -> pa.Table:
        shingle = Shingler(k)
        sets = [shingle(t) for t in batch.column("text").to_pylist()]
        found = linked(batch.column("id").to_numpy(), sets, batch.column("label").to_numpy(), batch.column("active").to_numpy(), num, den)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return tiles.groupBy("coarse", "i", "j").applyInArrow(run, "a long, b long")


def _block(n: str, salt: int, size: int):
    """A member's block, of blocks that hold `size` members on the average."""
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.ceil(F.col(n) / size)).cast("int")


def _first_tiles(members: DataFrame, payload: list[str], size: int) -> DataFrame:
    """Members in blocks; the hubs of a group of several blocks are also in each other block, passive."""
    own = members.withColumn("blocks", F.ceil(F.col("n") / size).cast("int")).withColumn("i", _block("n", 1, size))
    cols = ["coarse", "i", F.lit(-1).alias("j"), "id", F.col("id").alias("label")]
    hubs = own.where((F.col("blocks") > 1) & (F.pmod(F.xxhash64("id", F.lit(2)), F.ceil(F.col("n") / HUBS)) == 0))
    hubs = hubs.withColumn("own", F.col("i")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("i != own")
    return own.select(*cols, F.lit(True).alias("active"), *payload).unionByName(hubs.select(*cols, F.lit(False).alias("active"), *payload))


def _rest_tiles(members: DataFrame, roots: DataFrame, payload: list[str], size: int) -> DataFrame:
    """For groups of several blocks: classes outside the main component, in blocks that meet one another and all blocks of it."""
    large = members.where(F.col("n") > size)
    named = large.join(roots.select(F.col("id"), F.col("root")), "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
    sizes = named.groupBy("coarse", "label").agg(F.count("*").alias("size"))
    groups = sizes.groupBy("coarse").agg(F.max(F.struct("size", "label")).alias("main"), F.sum("size").alias("all")).select("coarse", F.col("main.label").alias("main"), F.col("main.size").alias("held"), (F.col("all") - F.col("main.size")).alias("rest")).where("rest > 0")
    named = named.join(groups, "coarse").withColumn("active", F.col("label") != F.col("main"))
    rests, mains = F.ceil(F.col("rest") / size).cast("int"), F.ceil(F.col("held") / size).cast("int")
    cols = ["coarse", "i", "j", "id", "label", "active", *payload]
    rest = named.where("active").withColumn("b", _block("rest", 3, size))
    # block pairs of the rest: tile (lesser, greater); with the main component: (block, rest blocks + its block)
    pairs = rest.withColumn("x", F.explode(F.sequence(F.lit(0), rests + mains - 1))).withColumn("i", F.when(F.col("x") < rests, F.least("b", "x")).otherwise(F.col("b"))).withColumn("j", F.when(F.col("x") < rests, F.greatest("b", "x")).otherwise(F.col("x")))
    main = named.where(~F.col("active")).withColumn("j", rests + _block("held", 4, size)).withColumn("i", F.explode(F.sequence(F.lit(0), rests - 1)))
    return pairs.select(*cols).unionByName(main.select(*cols))


def groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents link when den * intersection >= num * union of their k-word shingles."""
    if 2 * num <= den:
        raise ValueError("thresholds above 1/2 only: signatures are halved once, and sizes lie within a factor of two")
    docs = documents_text(docs)
    made = materialize(shingle_sets(docs, k, num, den), "jaccard-made")
    sets = materialize(made.drop("prefix"), "jaccard-sets")
    full = sets.where("n_shingles > 0")
    classes = full.groupBy("n_shingles", "digest").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "jaccard-classes")
    reps = made.where("n_shingles > 0").join(classes.select(F.col("rep").alias("doc_id"), F.col("n_shingles"), "digest"), ["doc_id", "n_shingles", "digest"], "left_semi")
    # prefixes and their tokens take the most room, so each step's table goes as soon as the next is there
    prefixes = materialize(reps.select(F.col("doc_id").alias("id"), "prefix"), "jaccard-prefixes")
    drop(made)
    # tokens are dealt out once, for counting and for what is left; most stand in one class only
    tokens = prefixes.select("id", F.explode("prefix").alias("token")).repartition("token")
    shared = tokens.groupBy("token").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("many")).where("least != most").select("token", "many")
    found = materialize(tokens.join(shared, "token"), "jaccard-tokens")
    drop(prefixes)
    rows = found.join(full.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "signature"), "id")
    coarse = components(candidates(rows, num, den))
    counts = coarse.groupBy("root").agg(F.count("*").alias("n")).withColumnRenamed("root", "coarse")
    members = coarse.select("id", F.col("root").alias("coarse")).join(counts, "coarse")
    members = materialize(docs.withColumnRenamed("doc_id", "id").join(members.hint("merge"), "id").select("id", "coarse", "n", "text"), "jaccard-members")
    # rows that share an id are told apart by their sets; links and labels go by id
    one = materialize(verified(_first_tiles(members, ["text"], TILE), k, num, den), "jaccard-links")
    two = materialize(verified(_rest_tiles(members, components(one), ["text"], TILE), k, num, den), "jaccard-links")
    same = full.join(classes, ["n_shingles", "digest"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a != b")
    roots = components(one.unionByName(two).unionByName(same))
    return sets.select("doc_id", "n_shingles").join(roots.select(F.col("id").alias("doc_id"), "root"), "doc_id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of near copies, with the columns of docs: that with the least id, null ids last, and of several such the least key.

    A row's key is a hash of its id and text, so rows that share an id are linked
    by their texts only, and rows with null ids are judged like others. Rows of
    the same id and text are copies; without text too.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    found = groups(docs.select(key.alias("doc_id"), "text"), k, num, den).select(F.col("doc_id").alias("key"), "component_id").distinct()
    slim = docs.select(key.alias("key"), F.col("doc_id").alias("own")).distinct()
    first = slim.join(found.hint("merge"), "key").groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", "key")).alias("least")).select(F.col("least.key").alias("key"))
    packed = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))  # the join has dealt the rows out by key already
    return packed.join(first.hint("merge"), "key", "left_semi").withColumn("nth", nth).where("nth = 1").select("row.*")
