"""Byte-pair encoding with a SentencePiece vocabulary, by vectorised merge rounds.

The symbols of all words of a block lie in one flat numpy array. Each round
finds every word's minimum pair rank by a segmented reduction, merges that
pair wherever it stands in the word, leftmost first, and compacts the array;
words with no pair left leave the array. The loop ends when it is empty.

Two places need care to equal the library, which merges one pair at a time:
 - a merged piece p may complete a piece of the same or a better rank (one
   that has p as a proper prefix or suffix). Such a rank is *contested*: only
   its leftmost pair is merged in a round.
 - a word can be very long. Cuts are made where no piece of the vocabulary has
   the two characters side by side, which no merge can cross; what is still
   longer than LONG goes through an ordinary heap, one merge at a time.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np

SPACE = "▁"
BOS, EOS = 1, 2
LONG = 256
_SHIFT = np.int64(21)
_UNKNOWN = 1 << 16
_NONE = np.int32(1 << 30)
_WORDS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
#: Words that a worker remembers, with their ids.
CACHE_WORDS = 200_000


class PairTable:
    """An open-addressing hash table from pairs of symbols to merged pieces, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        self.probes = 1
        while len(left):
            free = self.keys[slot[left]] == -1
            first = np.unique(slot[left[free]], return_index=True)[1]
            put = left[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask
            self.probes += bool(len(left))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class PieceCodec:
    """Encodes and decodes as the library does with this model: a space before the text, no normalisation, bytes for unknown characters."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        scores = np.array([sp.get_score(i) for i in range(n)])
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        ids = {p: i for i, (p, s) in enumerate(zip(self.pieces, special)) if not s}
        self.rank = np.zeros(n, np.int32)
        order = np.unique(-scores[list(ids.values())])
        for p, i in ids.items():
            self.rank[i] = np.searchsorted(order, -scores[i])
        self.first = np.arange(0x110000, dtype=np.int64) + _UNKNOWN
        for p, i in ids.items():
            if len(p) == 1:
                self.first[ord(p)] = i
        best, keys, values, beside = {}, [], [], set()
        contested = np.bincount(self.rank[list(ids.values())], minlength=len(order)) > 1
        for p, i in ids.items():
            for k in range(1, len(p)):
                left, right = p[:k], p[k:]
                beside.add((ord(p[k - 1]) << 21) | ord(p[k]))
                for part in (left, right):
                    best[part] = min(best.get(part, _NONE), self.rank[i])
                a = ids.get(left, self.first[ord(left)] if len(left) == 1 else None)
                b = ids.get(right, self.first[ord(right)] if len(right) == 1 else None)
                if a is not None and b is not None:
                    keys.append((int(a) << 21) | int(b))
                    values.append(i)
        for p, i in ids.items():
            contested[self.rank[i]] |= best.get(p, _NONE) <= self.rank[i]
        self.contested = contested
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.merged = dict(zip(keys, values))
        self.beside = beside
        self.joined = PairTable(np.array(sorted(beside), np.int64), np.ones(len(beside), np.int32))
        self.bytes_of = [b"" if s else p.encode() for p, s in zip(self.pieces, special)]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        if sp.unk_id() >= 0:
            self.bytes_of[sp.unk_id()] = " ⁇ ".encode()
        self.cache: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        ids, sizes = self.encode_flat(words)
        data, ends = ids.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        starts = np.zeros(len(points), bool)
        starts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        word = np.repeat(np.arange(len(words)), lengths)
        wide = np.flatnonzero(lengths[word[1:]] > 48) + 1 if len(points) > 1 else np.zeros(0, np.int64)
        if len(wide):
            starts[wide[self.joined.get((points[wide - 1] << _SHIFT) | points[wide]) < 0]] = True
        segment = np.cumsum(starts) - 1
        symbols = self.first[points]
        sizes = np.bincount(segment)
        long_ = np.flatnonzero(sizes > LONG)
        at, out = np.arange(len(points)), []
        if len(long_):
            bounds = np.cumsum(sizes)
            for s in long_:
                begin = bounds[s] - sizes[s]
                ids = self._heap(symbols[begin : bounds[s]].tolist())
                out.append((np.full(len(ids), begin), np.array(ids, np.int64), np.arange(len(ids))))
            live = sizes[segment] <= LONG
            symbols, segment, at = symbols[live], segment[live], at[live]
        got_at, got = self._rounds(symbols, segment, at)
        out.append((got_at, got, np.zeros(len(got), np.int64)))
        at, ids, sub = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((sub, at))
        at, ids = at[order], ids[order]
        of = word[at]
        unknown = np.flatnonzero(ids >= _UNKNOWN)
        if len(unknown):
            raw = [self.byte_ids[list(chr(i - _UNKNOWN).encode("utf-8", "replace"))] for i in ids[unknown].tolist()]
            count = np.ones(len(ids), np.int64)
            count[unknown] = [len(r) for r in raw]
            put = (np.cumsum(count) - count)[unknown]
            ids, of = np.repeat(ids, count), np.repeat(of, count)
            for p, r in zip(put.tolist(), raw):
                ids[p : p + len(r)] = r
        return ids, np.bincount(of, minlength=len(words))

    def _rounds(self, symbols: np.ndarray, segment: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done_at, done = [], []
        if not len(symbols):
            return at, symbols
        merged = self._merged(symbols, segment, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            sizes = np.diff(np.r_[starts, len(segment)])
            rank = np.where(merged >= 0, self.rank[merged], _NONE)
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = least == _NONE
            if over.any():
                done_at.append(at[over])
                done.append(symbols[over])
                live = ~over
                symbols, segment, at, merged, rank, least = (x[live] for x in (symbols, segment, at, merged, rank, least))
                if not len(symbols):
                    break
            pick = np.flatnonzero(rank == least)
            fresh = np.r_[True, segment[pick[1:]] != segment[pick[:-1]]]
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(pick) != 1], np.arange(len(pick)), 0))
            pick = pick[np.where(self.contested[least[pick]], fresh, (np.arange(len(pick)) - run) % 2 == 0)]
            symbols[pick] = merged[pick]
            keep = np.ones(len(symbols), bool)
            keep[pick + 1] = False
            pick = (np.cumsum(keep) - 1)[pick]
            symbols, segment, at, merged = (x[keep] for x in (symbols, segment, at, merged))
            for near in (pick, pick[pick > 0] - 1):
                merged[near] = self._merged(symbols, segment, near)
        return np.concatenate(done_at), np.concatenate(done)

    def _merged(self, symbols: np.ndarray, segment: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The piece that each symbol makes with the next one of its word, or -1."""
        nxt = np.minimum(at + 1, len(symbols) - 1)
        out = self.pairs.get((symbols[at] << _SHIFT) | symbols[nxt])
        out[(segment[at] != segment[nxt]) | (nxt == at)] = -1
        return out

    def _heap(self, symbols: list[int]) -> list[int]:
        """One merge at a time, best rank and then leftmost first."""
        n = len(symbols)
        prev, nxt, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (m := self.merged.get((symbols[i] << 21) | symbols[j])) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, symbols[i], symbols[j], m))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            if not alive[i] or symbols[i] != a or (j := nxt[i]) >= n or symbols[j] != b:
                continue
            symbols[i], alive[j] = m, False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return [s for s, a in zip(symbols, alive) if a]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text without begin and end; words are encoded once and remembered."""
        cache = self.cache
        split = [_WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        missing = list({w for words in split for w in set(words) if w not in cache})
        fresh = dict(zip(missing, self.encode_words(missing)))
        if len(cache) + len(fresh) > CACHE_WORDS:
            known = {w: cache[w] for words in split for w in words if w in cache}
            cache.clear()
            fresh |= known
        cache.update({w: x for w, x in fresh.items() if len(w) <= 64})
        get = cache.__getitem__
        if len(cache) < len(fresh) or any(len(w) > 64 for w in missing):
            get = lambda w: cache[w] if w in cache else fresh[w]
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids vanish, one leading space goes, invalid bytes become U+FFFD each."""
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        mark = SPACE.encode()
        data = data[len(mark) :] if data.startswith(mark) else data
        return _lenient(data).replace(SPACE, " ")


def _lenient(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            try:
                out.append(data[at:].decode())
                break
            except UnicodeDecodeError as e:
                out.append(data[at : at + e.start].decode() + "�")
                at += e.start + 1
        return "".join(out)


@lru_cache(2)
def codec(model_path: str) -> PieceCodec:
    """One codec per worker process and model."""
    return PieceCodec(model_path)
