"""Mixture-controlled packing of token ids into sequences of fixed length.

Each source is a queue. Deficit round-robin serves the queue whose deficit is largest: token c of a queue with weight w is due
at (c + 1/2) / w, and the stream takes tokens in the order in which they are due. So any stretch of the
stream, and every window, holds each source at its target share within a few tokens at most, and what rounding leaves
over carries to the next window. How many tokens each queue has given before a window has a closed form but for a few
tokens, so a document's pieces follow from its place in its queue, and deficits carry across windows and partitions
without a walk through the windows. Once a queue is empty the others share by their weights. By
default weights are the numbers of tokens themselves, so that all queues end together. Queues without a weight come last.

What remains at the end is cut into sequences whose lengths are powers of two, so nothing is padded.
Null texts are empty; every row gives at least its end token. Null sources are a source of their own. Repeated rows are
documents of their own; tokens that are due at once go by the order of sources. A very long text is tokenised in parts, and its
pieces are as many as the windows it spans. An empty table gives an empty result. Columns other than doc_id, the source and the
text are not looked at. The driver holds two numbers for each source, whatever their number, and sends them to the tasks.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Sequence
from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import lcm

import numpy as np
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import map_slices, spill

#: Pieces of text between white space, and words in them, that a task keeps; beyond, the older half of the words and all pieces go.
PIECES, WORDS = 1_500_000, 80_000
#: Bytes of text whose pieces are found at a time; a task needs about 40 times as many for it.
BATCH = 500_000
#: Between these characters (printable ASCII and Latin-1 letters) case folding and composition are one to one, so that
#: the tokenizer's own word pattern can be applied before it.
PLAIN = re.compile("[!-~\u00c0-\u00ff]*")
#: The pattern by which the tokenizer splits words.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class _Recent(dict):
    """A cache of two generations: what is asked for moves to the young one, and the old one goes when that is full."""

    def __init__(self, most: int, make) -> None:
        self.most, self.make = most, make
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _parts(data: bytes):
    """Cuts a long text at white space."""
    at = 0
    while len(data) - at > BATCH:
        cut = max(data.rfind(b" ", at, at + BATCH), data.rfind(b"\n", at, at + BATCH))
        if cut < at:  # one word as long as a batch
            cut = min((x for x in (data.find(b" ", at), data.find(b"\n", at)) if x >= 0), default=len(data))
        yield data[at:cut]
        at = cut + 1
    yield data[at:]


class Encoder:
    """Ids of texts. White space separates tokens, so what stands between spaces and line feeds is encoded once and kept, under a
    64-bit hash and its length; so are the words within, in lower case, where `folded` says that the tokenizer lowers case
    and splits by PARTS."""

    def __init__(self, path: str, wide: str, folded: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide, self.width, self.folded = wide, int(wide[-1]), folded
        self.words = _Recent(WORDS, self._word)
        self._forget()
        self.pack = struct.Struct("<H" if wide == "<u2" else "<I").pack
        # byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes for characters from 256 on
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in seen]
        self.letters = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _forget(self) -> None:
        # pieces by rising hash: hash, length in bytes, place and number of ids in the pool
        self.keys, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begins, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, self.wide)

    def _known(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each of the rising keys is kept."""
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return (self.keys[at] == keys) & (self.sizes[at] == sizes)

    def _keep(self, keys: np.ndarray, sizes: np.ndarray, ids: list[bytes]) -> None:
        counts = np.array([len(x) for x in ids], np.int32) // self.width
        begins = len(self.pool) + np.cumsum(counts, dtype=np.int64) - counts
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), self.wide)])
        at = np.searchsorted(self.keys, keys)
        for name, new in (("keys", keys), ("sizes", sizes), ("begins", begins), ("counts", counts)):
            setattr(self, name, np.insert(getattr(self, name), at, new))

    def _ids(self, ids) -> bytes:
        return b"".join(map(self.pack, ids))

    def _word(self, word: str) -> bytes:
        """A plain word goes to the tokenizer's model at once, its bytes spelt as its alphabet spells them."""
        spelt = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return self._ids([t.id for t in self.tokenizer.model.tokenize(spelt)])

    def _piece(self, piece: str) -> bytes:
        if self.folded and "<|" not in piece and PLAIN.fullmatch(piece):
            low = piece.lower()
            if low.isalpha():
                return self.words[low]
            return b"".join([self.words[p] for p in PARTS.findall(low)])
        return self._ids(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """Little-endian ids of every text and the end id."""
        out: list[list[bytes]] = [[] for _ in texts]
        some: list[bytes] = []
        owner: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            for part in _parts((t or "").encode()):
                some.append(part)
                owner.append(i)
                size += len(part)
                if size >= BATCH:
                    for o, x in zip(owner, self._batch(some), strict=True):
                        out[o].append(x)
                    some, owner, size = [], [], 0
        for o, x in zip(owner, self._batch(some) if some else [], strict=True):
            out[o].append(x)
        last = self.pack(end)
        return [b"".join(x) + last for x in out]

    def _batch(self, texts: list[bytes]) -> list[bytes]:
        """Finds the pieces by arrays, looks each distinct one up once, and lays their ids out by arrays."""
        data = b"\n".join(texts) + b"\n"
        codes = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero((codes == 32) | (codes == 10))
        starts = np.r_[0, ends[:-1] + 1]
        full = ends > starts
        starts, ends = starts[full], ends[full]
        size = ends - starts
        bounds = np.cumsum([len(t) + 1 for t in texts])
        if not len(starts):
            return [b""] * len(texts)
        # a hash of each piece: a random number for each byte and place, added up; capitals count as small letters
        table = _TABLE if not self.folded or b"<|" in data else _FOLDED
        at = np.arange(size.sum(), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        row = np.repeat((starts - (np.cumsum(size) - size)).astype(at.dtype), size)  # from a place among the pieces to its place in data
        letters = codes[row + at]
        at -= np.repeat((np.cumsum(size) - size).astype(at.dtype), size)
        values = table[np.minimum(at, PLACES - 1, out=at), letters]
        h = np.add.reduceat(values, np.r_[0, np.cumsum(size)[:-1]])
        for i in np.flatnonzero(size >= PLACES):
            h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        sizes = size[first].astype(np.int32)
        if len(self.keys) + len(keys) > PIECES:
            self._forget()
        new = ~self._known(keys, sizes)
        at = first[new]
        self._keep(keys[new], sizes[new], [self._piece(data[a:b].decode()) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        at = np.searchsorted(self.keys, keys)
        n = self.counts[at][which].astype(np.int64)
        where = np.cumsum(n)
        ids = self.pool[np.repeat(self.begins[at][which] - (where - n), n) + np.arange(where[-1])]
        cut = np.r_[0, np.r_[0, where][np.searchsorted(starts, bounds)]].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]


#: Places of a piece that the hash tells apart; longer pieces are hashed as a whole.
PLACES = 48
_TABLE = np.random.default_rng(11).integers(0, 1 << 64, (PLACES, 256), np.uint64)
_FOLDED = _TABLE.copy()
_FOLDED[:, 65:91] = _TABLE[:, 97:123]


class Plan:
    """Where the tokens of the queues go. totals: tokens of each queue; weights: None for these, or a number for each."""

    #: Numbers kept for windows already asked for.
    ROOM = 2_000_000

    def __init__(self, totals: Sequence[int], weights: Sequence[float] | None, capacity: int) -> None:
        self.totals, self.total, self.capacity = list(totals), sum(totals), capacity
        w = [Fraction(x) for x in (weights or totals)]
        one = lcm(*{x.denominator for x in w}) if w else 1
        self.late = [x <= 0 for x in w]
        self.weights = [int(x * one) if x > 0 else n for x, n in zip(w, totals, strict=True)]
        # for each of the two rounds: when queues run empty, with the tokens of the empty ones, the weight of the others, and the place
        self.rounds = []
        for late in (False, True):
            on = sorted((Fraction(n, self.weights[i]), n, self.weights[i]) for i, n in enumerate(totals) if n and self.late[i] == late)
            gone, rate, places = 0, sum(r for _, _, r in on), []
            for end, n, r in on:
                places.append((gone + rate * end, gone, rate))
                gone, rate = gone + n, rate - r
            self.rounds.append((places, sum(n for _, n, _ in on)))
        self.ends = [[Fraction(n, self.weights[i]) for i, n in enumerate(totals) if n and self.late[i] == late] for late in (False, True)]
        for e in self.ends:
            e.sort()
        self.cuts: dict[int, list[int]] = {}

    def _at(self, y: int, late: bool) -> tuple[int, int]:
        """The virtual time at which so many tokens of a round are given, as numerator and denominator, but for rounding."""
        places = self.rounds[late][0]
        _, gone, rate = places[min(bisect_left(places, y, key=lambda p: p[0]), len(places) - 1)]
        return y - gone, rate

    def given(self, x: int) -> list[int]:
        """How many tokens of each queue are among the first x of the stream."""
        if x in self.cuts:
            return self.cuts[x]
        if len(self.cuts) * max(1, len(self.totals)) > self.ROOM:
            self.cuts.clear()
        early = self.rounds[0][1]
        late = x > early
        y, c = x - early if late else x, [0] * len(self.totals)
        if late:
            c = [0 if z else n for n, z in zip(self.totals, self.late, strict=True)]
        if y:
            on = [i for i, z in enumerate(self.late) if z == late]
            a, b = self._at(y, late)
            for i in on:
                c[i] = min(self.totals[i], (2 * self.weights[i] * a + b) // (2 * b))
            # exact ranks: the few tokens about the cut change places until those before it are due first
            due = lambda i, n: ((2 * n + 1) << 64) // self.weights[i]
            last = [(-due(i, c[i] - 1), -i) for i in on if c[i]]
            new = [(due(i, c[i]), i) for i in on if c[i] < self.totals[i]]
            heapify(last)
            heapify(new)
            over = sum(c[i] for i in on) - y
            while over or (last and new and (-last[0][0], -last[0][1]) > new[0]):
                if over >= 0:  # the last token goes back
                    i = -heappop(last)[1]
                    c[i] -= 1
                    # the token in the other heap that followed it is no longer the next
                    new = [z for z in new if z[1] != i]
                    new.append((due(i, c[i]), i))
                    heapify(new)
                    if c[i]:
                        heappush(last, (-due(i, c[i] - 1), -i))
                    over -= 1
                else:
                    i = heappop(new)[1]
                    c[i] += 1
                    last = [z for z in last if z[1] != -i]
                    last.append((-due(i, c[i] - 1), -i))
                    heapify(last)
                    if c[i] < self.totals[i]:
                        heappush(new, (due(i, c[i]), i))
                    over += 1
        self.cuts[x] = c
        return c

    def window(self, x: int) -> tuple[int, int, int]:
        """Number, start and end of the sequence that holds token x of all."""
        w, full = x // self.capacity, self.total // self.capacity
        if w < full:
            return w, w * self.capacity, (w + 1) * self.capacity
        at, left, w = full * self.capacity, self.total % self.capacity, full
        while True:
            size = 1 << (left.bit_length() - 1)
            if x < at + size:
                return w, at, at + size
            at, left, w = at + size, left - size, w + 1

    def pieces(self, queue: int, first: int, n: int) -> list[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset) for the n tokens of a queue from number first on."""
        out, u, end = [], first, first + n
        late, w = self.late[queue], self.weights[queue]
        places, early = self.rounds[late][0], self.rounds[0][1]
        when = Fraction(2 * first + 1, 2 * w)
        k = self.ends[late]
        _, gone, rate = places[min(bisect_left(k, when), len(places) - 1)]
        at = min(self.total - 1, max(0, int(gone + rate * when)) + (early if late else 0))
        while u < end:
            number, lo, hi = self.window(at)
            before, after = self.given(lo), self.given(hi)
            if before[queue] > u:
                at = lo - 1
                continue
            if after[queue] > u:
                size = min(end, after[queue]) - u
                out.append((u - first, size, number, sum(after[:queue]) - sum(before[:queue]) + u - before[queue]))
                u += size
            at = hi
        return out


def pack(docs: DataFrame, path: str, vocabulary: int, capacity: int = 2048, end: int = 1, weights: dict | None = None, text: str = "text", source: str = "source", folded: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    weights: tokens of each source for one of another; sources that it lacks come last. Ids are stored as 16 bits if they fit.
    folded: the tokenizer at path lowers case and splits by PARTS, as the 49k word tokenizer does.
    """
    wide = "<u2" if max(vocabulary, end + 1) <= 1 << 16 else "<u4"
    rows = docs.select("doc_id", F.col(source).cast("string").alias("source"), F.col(text).alias("text"))

    def tokenise():
        chunk, seen = TaskContext.get().partitionId(), {}
        encoder = Encoder(path, wide, folded)  # a task's own: workers stay while later stages need the memory

        def each(r: dict[str, list]) -> dict[str, list]:
            ids = encoder.encode(r["text"], end)
            n = [len(x) // int(wide[-1]) for x in ids]
            base = []
            for q, x in zip(r["source"], n, strict=True):
                base.append(seen.get(q, 0))
                seen[q] = base[-1] + x
            return {"doc_id": r["doc_id"], "source": r["source"], "chunk": [chunk] * len(n), "base": base, "n": n, "ids": ids}

        return each

    stored = spill(map_slices(rows, tokenise, "doc_id long, source string, chunk int, base long, n long, ids binary", rows=1024), "pack-ids")
    sums = spill(stored.groupBy("chunk", "source").agg(F.sum("n").alias("n")), "pack-sums")
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = sorted(((r[0], int(r[1])) for r in sums.groupBy("source").agg(F.sum("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    number = {q: i for i, (q, _) in enumerate(totals)}
    counts = [n for _, n in totals]
    plan = Plan(counts, [weights.get(q, 0) for q, _ in totals] if weights else None, capacity)
    starts = spill(sums.select(F.col("chunk").alias("chunk_"), F.col("source").alias("source_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "pack-starts")
    placed = stored.join(starts, (stored.chunk == starts.chunk_) & stored.source.eqNullSafe(starts.source_)).select("doc_id", "source", (F.col("first") + F.col("base")).alias("first"), "n", "ids")
    sent = docs.sparkSession.sparkContext.broadcast((plan, number))  # two numbers a source

    def cut():
        plan, number = sent.value

        def each(r: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")}
            for doc, src, first, n, ids in zip(*(r[c] for c in ("doc_id", "source", "first", "n", "ids")), strict=True):
                data = memoryview(np.frombuffer(ids, wide).astype("<u4").tobytes())
                got = plan.pieces(number[src], first, n)
                starts, lengths, numbers, offsets = zip(*got, strict=True)
                out["doc_id"] += [doc] * len(got)
                out["source"] += [src] * len(got)
                out["doc_tokens"] += [n] * len(got)
                out["start"] += starts
                out["length"] += lengths
                out["sequence_id"] += numbers
                out["offset"] += offsets
                out["ids_crc32"] += [zlib.crc32(data[4 * s : 4 * (s + x)]) for s, x in zip(starts, lengths, strict=True)]
            return out

        return each

    return map_slices(placed, cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
