"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

A text's words are covered where a window of `window` consecutive words also starts elsewhere, in another document
or in the same one. The reference is the whole corpus. It is indexed by anchors: of the word k-grams inside a window, the
one with the least hash (the leftmost of equals) is its anchor, so equal windows have equal anchors at equal offsets.
Each place of an anchor that has several places gives a segment: the words of the windows around it that it anchors.
All segments of some anchors make up a reference block, whose index is a sorted array of its suffixes that begin a window.

Each segment is parsed greedily against its block: from a word on, the longest factor that also starts at another place
of the block is taken from the index with its source, if it has at least a window's words, else one word is passed;
the next factor begins where the last one ended. At the boundaries between factors the windows that lie across are
looked up too, as a window in two factors can have a source of its own. What factors and those windows cover are the
duplicate spans. Words are compared themselves, not their hashes.

The number of blocks follows the number of segments. An anchor with more than `hot` places is no key to deal by: its
windows are dealt by their own 128-bit digest instead, so a block's reference for them is one window, which is its own
longest factor. An anchor's number of places bounds those of its windows, so it says into how many parts their places
are dealt by hash; first and last place and number are found for each part and then over the parts, and places are
joined with their part. So no task sees more than a bounded number of segments or places of one window, and the
rows that any step makes are at most the places.

Equal texts are parsed once; when there are two or more with at least one window, all of their words go. Null and empty
texts have no words, shorter texts than a window no window. Repeated rows are equal texts; a doc_id may repeat or be null.
A very long text is one row with many segments. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm import words
from nearfield.llm.common import map_slices, spill

EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Settings:
    window: int = 35
    k: int = 10
    #: Places of an anchor above which its windows are dealt singly, and segments in a reference block, about.
    hot: int = 512
    block: int = 2_000
    #: Places of a hot anchor's window in a part, at most about.
    share: int = 1_000


def anchors(h: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(k-gram hashes, the position of its anchor for each window)."""
    if len(h) < s.window:
        return h[:0], np.zeros(0, np.int64)
    g = words.runs(h, s.k)
    width = s.window - s.k + 1
    at = np.empty(len(h) - s.window + 1, np.int64)
    for i in range(0, len(at), 1 << 16):
        part = np.lib.stride_tricks.sliding_window_view(g[i : i + (1 << 16) + width - 1], width)
        at[i : i + len(part)] = part.argmin(axis=1) + np.arange(i, i + len(part))
    return g, at


def _first_pass(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, k1, k2, n_words, sha256, and the anchors (hash, position) of texts that this task has not met."""

    def make():
        met: set[tuple[int, int]] = set()

        def each(r: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": r["doc_id"], "k1": r["k1"], "k2": r["k2"], "n_words": [], "sha256": [], "grams": [], "places": []}
            for key, text in zip(zip(r["k1"], r["k2"], strict=True), r["text"], strict=True):
                w = words.split(text)
                out["n_words"].append(len(w))
                out["sha256"].append(hashlib.sha256(b" ".join(w)).hexdigest())
                g, at = anchors(words.hashes(w) if len(w) >= s.window and key not in met else np.zeros(0, np.uint64), s)
                if len(met) < 200_000:
                    met.add(key)
                at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
                out["grams"].append(g[at].view(np.int64))
                out["places"].append(at.astype(np.int32))
            return out

        return each

    return map_slices(docs, make, "doc_id long, k1 long, k2 long, n_words long, sha256 string, grams array<long>, places array<int>")


def _segments(staged: DataFrame, s: Settings) -> DataFrame:
    """A row for each place of a repeated anchor in a text: key, c (the text), first (window), windows, words; for hot anchors a row
    for each window, with its digest (d1, d2) for the words and the binary logarithm of its number of parts."""

    def make():
        def each(r: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {n: [] for n in ("key", "c", "first", "windows", "words", "d1", "d2", "bits")}

            def add(*values) -> None:
                for column, v in zip(out.values(), values, strict=True):
                    column.append(v)

            for c, text, marks in zip(r["c"], r["text"], r["marks"], strict=True):
                w = words.split(text)
                g, at = anchors(words.hashes(w), s)
                marks = np.sort(np.array(marks, np.int64))
                known, hot = marks >> 5, marks & 31
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
                ends = np.r_[starts[1:], len(at)]
                where = np.searchsorted(known, at[starts])
                for a, b, i in zip(starts.tolist(), ends.tolist(), where.tolist(), strict=True):
                    if i < len(known) and known[i] == at[a]:
                        if hot[i]:
                            for j in range(a, b):
                                d = xxhash.xxh3_128_digest(b" ".join(w[j : j + s.window]))
                                add(None, c, j, 1, None, *np.frombuffer(d, np.int64).tolist(), int(hot[i]) - 1)
                        else:
                            add(int(g[at[a]].view(np.int64)), c, a, b - a, b" ".join(w[a : b + s.window - 1]), None, None, None)
            return out

        return each

    return map_slices(staged.select("c", "text", "marks"), make, "key long, c long, first int, windows int, words binary, d1 long, d2 long, bits int")


def longest(ids: np.ndarray, stops: np.ndarray, begins: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of ids (from begins to its segment's end in stops): how many words it shares with the suffix that shares
    most, and which that is. Suffixes whose first window occurs once are told apart by its hash; the others are sorted."""
    length, source = np.zeros(len(begins), np.int64), np.full(len(begins), -1)
    h = words.runs(ids.astype(np.uint64), window)[begins]
    _, which, times = np.unique(h, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[which] > 1)
    if not len(some):
        return length, source
    size = stops[some] - begins[some]
    width = int(size.max())
    place = begins[some, None] + np.arange(width)
    rows = np.where(np.arange(width) < size[:, None], ids[np.minimum(place, len(ids) - 1)] + 1, 0).astype(">i4")  # 0: the segment has ended
    order = np.argsort(rows.view(f"V{4 * width}").ravel(), kind="stable")
    rows, some = rows[order], some[order]
    same = (rows[1:] == rows[:-1]) & (rows[1:] > 0)
    shared = np.where(same.all(axis=1), width, same.argmin(axis=1))
    before, after = np.r_[0, shared], np.r_[shared, 0]
    length[some] = np.maximum(before, after)
    up = np.where(before >= after, np.arange(len(some)) - 1, np.arange(len(some)) + 1)
    source[some] = np.where(length[some] > 0, some[np.clip(up, 0, len(some) - 1)], -1)
    return length, source


def factors(length: np.ndarray, windows: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """Greedy factors, as numbers of suffixes and lengths. length: the longest match of each window start, segment by segment;
    windows: starts in each segment. After a factor, the windows across its end are looked up one by one."""
    found, sizes = [], []
    hits = np.flatnonzero(length >= window)
    segment_end = np.repeat(np.cumsum(windows), windows)[hits].tolist()
    lengths = length[hits].tolist()
    at, end, here = -1, -1, -1  # the next word to parse from, the last factor's end, the segment's end
    for i, stop, n in zip(hits.tolist(), segment_end, lengths, strict=True):
        if stop != here:
            at, end, here = i, -1, stop
        if i < at and i + window <= end:
            continue  # inside the last factor
        # a factor from here, or a window across the boundary, of which only the first window's words are known to be new
        n = n if i >= at else min(n, window)
        found.append(i)
        sizes.append(n)
        if i >= at:
            at = end = i + n
        end = max(end, i + n)
    return found, sizes


def _parse(s: Settings):
    schema = pa.schema([("c", pa.int64()), ("first", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("source_first", pa.int32())])

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("c", "ascending"), ("first", "ascending")])
        c, first, windows = (block[x].to_numpy().astype(np.int64) for x in ("c", "first", "windows"))
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for x in block["words"] for w in x.as_py().split(b" ")], np.int64)
        size = windows + s.window - 1
        segment = np.cumsum(size) - size
        row = np.repeat(np.arange(len(c)), windows)
        place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        length, source = longest(ids, (segment + size)[row], segment[row] + place, s.window)
        found, sizes = factors(length, windows, s.window)
        found = np.array(found, np.int64)
        of = source[found]
        return pa.table([c[row[found]], (first[row] + place)[found].astype(np.int32), np.array(sizes, np.int32), c[row[of]], (first[row] + place)[of].astype(np.int32)], schema=schema)

    return run, "c long, first int, words int, source long, source_first int"


def _finish(rows: DataFrame, s: Settings) -> DataFrame:
    """k1, k2, n_removed, kept_sha256 of texts with spans."""

    def make():
        def each(r: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"k1": r["k1"], "k2": r["k2"], "n_removed": [], "kept_sha256": []}
            for text, spans in zip(r["text"], r["spans"], strict=True):
                w = words.split(text)
                keep = kept_words(w, [(x["first"], x["first"] + x["words"]) for x in spans])
                out["n_removed"].append(len(w) - len(keep))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(keep)).hexdigest())
            return out

        return each

    return map_slices(rows, make, "k1 long, k2 long, n_removed long, kept_sha256 string")


def kept_words(w: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    """The words outside all spans (from, to)."""
    edge = np.zeros(len(w) + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return [x for x, n in zip(w, np.cumsum(edge)[:-1], strict=True) if not n]


def spans(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, contents, found): each row's text key, word count and hash; the distinct texts; and those with duplicate
    spans, as c, k1, k2, text and spans, an array of (first, words, source, source_first): the factors, each with the text and the
    word at which its source starts."""
    key1, key2 = F.xxhash64(text), F.xxhash64(F.lit("second"), text)
    keyed = docs.select("doc_id", key1.alias("k1"), key2.alias("k2"), F.col(text).alias("text"))
    each = spill(_first_pass(keyed, s), "substring-documents")
    contents = each.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("n_words").alias("n_words"))
    contents = spill(contents.withColumn("c", F.monotonically_increasing_id()), "substring-contents")
    marks = each.select("k1", F.inline(F.arrays_zip("grams", "places")))
    address = F.xxhash64("k1", "places")
    twice = marks.groupBy("grams").agg(F.min(address).alias("low"), F.max(address).alias("high"), F.count("*").alias("n")).filter("low < high")
    bits = F.greatest(F.lit(0), F.least(F.lit(30), F.ceil(F.log2(F.col("n") / s.share)).cast("int")))
    twice = spill(twice.select(F.col("grams").alias("gram"), F.when(F.col("n") > s.hot, bits + 1).otherwise(0).alias("hot")), "substring-anchors")
    found = marks.join(twice, F.col("grams") == F.col("gram")).groupBy("k1").agg(F.collect_set(F.col("places").cast("long") * 32 + F.col("hot")).alias("marks"))
    wanted = found.withColumnRenamed("k1", "k1_").join(contents.select(F.col("k1").alias("k"), F.col("k2").alias("k2_"), F.col("least"), "c"), F.col("k1_") == F.col("k"))
    wanted = spill(wanted.select("k1_", "k2_", "least", "c", "marks"), "substring-wanted")
    cond = (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_")) & F.col("doc_id").eqNullSafe(F.col("least"))
    staged = spill(keyed.join(wanted, cond).select("c", "k1", "k2", "text", "marks").dropDuplicates(["c"]), "substring-texts")
    segments = spill(_segments(staged, s), "substring-segments")
    run, schema = _parse(s)
    blocks = max(1, -(-segments.filter("key is not null").count() // s.block))
    cold = segments.filter("key is not null").select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "c", "first", "windows", "words").groupBy("block").applyInArrow(run, schema)
    part = F.pmod(F.xxhash64("c", "first"), F.expr("shiftleft(1L, bits)"))
    single = segments.filter("key is null").select("d1", "d2", part.alias("part"), "c", "first")
    place = F.struct("c", "first")
    parts = spill(single.groupBy("d1", "d2", "part").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n")), "substring-parts")
    window = Window.partitionBy("d1", "d2")  # of a row for each part
    again = parts.select("d1", "d2", "part", F.min("low").over(window).alias("low"), F.max("high").over(window).alias("high"), F.sum("n").over(window).alias("n"))
    hot = single.join(spill(again.filter("n > 1").drop("n"), "substring-hot"), ["d1", "d2", "part"])
    other = F.when(F.col("low") == place, F.col("high")).otherwise(F.col("low"))
    hot = hot.select("c", "first", F.lit(s.window).alias("words"), other["c"].alias("source"), other["first"].alias("source_first"))
    all_spans = cold.union(hot).groupBy("c").agg(F.collect_list(F.struct("first", "words", "source", "source_first")).alias("spans"))
    return each, contents, staged.select("c", "k1", "k2", "text").join(spill(all_spans, "substring-spans"), "c")


def remove(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_removed, kept_sha256."""
    each, contents, found = spans(docs, s, text)
    whole = (F.col("copies") > 1) & (F.col("n_words") >= s.window)
    parsed = spill(_finish(found.select("k1", "k2", "text", "spans"), s), "substring-parsed")
    copied = contents.filter(whole).select("k1", "k2", F.col("n_words").alias("n_removed"), F.lit(EMPTY).alias("kept_sha256"))
    rest = parsed.join(copied.select("k1", "k2"), ["k1", "k2"], "left_anti")
    result = spill(copied.union(rest), "substring-result").withColumnsRenamed({"k1": "k1_", "k2": "k2_"})
    joined = each.select("doc_id", "k1", "k2", "n_words", "sha256").join(result, (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
