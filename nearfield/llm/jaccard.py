"""Similarity join of documents by the Jaccard index of their word n-grams.

Documents with equal n-gram sets form a class, which goes on as one row with its number of documents. MinHash
values in bands give candidates: only classes that share a band are ever compared. A pair's MinHash values are compared a
few at a time, and the pair is dropped once the posterior probability that its index reaches the threshold, given the
matches so far and a uniform prior, is below a tolerance. That happens twice. First on a byte of each value, within the
buckets of the bands: what a bucket's task returns is which members its surviving pairs connect, so classes
that only share a band by chance fall apart before any text is read. (Bytes agree wherever values do, so no pair is lost
that the values would keep.) Then, in each connected set of survivors, on the whole values, and what survives again is
verified on the n-gram sets. Buckets and sets are cut into chunks by hash; a task compares chunks and returns, for
each class, how many documents it links to and its root among the links found there, never the pairs; the roots are
joined into components.

Texts with fewer words than n have their words as the one n-gram. Null texts, empty texts and texts without words link
with nothing. Repeated rows are documents of one class. Pairs at the threshold itself link. A very long text is one set.
class_id is the smallest doc_id of a component, null if all are. An empty table gives an empty result. join() looks at
doc_id and the text column only; representatives() returns the columns of docs, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import words
from nearfield.llm.common import map_slices, spill
from nearfield.llm.components import components, roots


@dataclass(frozen=True)
class Settings:
    n: int = 5
    threshold: Fraction = Fraction(4, 5)
    #: A pair at the threshold shares none of the bands with probability (1 - threshold ** rows) ** bands: 3e-6.
    bands: int = 24
    rows: int = 4
    step: int = 16
    tolerance: float = 1e-6
    #: Classes in a chunk of a connected set and of a bucket, and members of buckets in a task, about.
    chunk: int = 96
    bucket: int = 512
    dealt: int = 20_000

    @property
    def values(self) -> int:
        return self.bands * self.rows


def grams(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams."""
    h = words.hashes(words.split(text))
    return np.unique(words.runs(h, min(n, len(h)))) if len(h) else h


def _coefficients(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, s.values, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, s.values, dtype=np.uint64)


def minhash(g: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(g), 2048):
        x = g[at : at + 2048, None] * a[None] + b[None]
        least = np.minimum(least, (x >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return least


def needed(s: Settings) -> dict[int, int]:
    """For each number of compared values, the fewest matches with which a pair stays.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail above t is P(Binomial(n + 1, t) <= m).
    """
    t, out = float(s.threshold), {}
    for n in range(s.step, s.values + 1, s.step):
        tail, m = 0.0, 0
        while m < n:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= s.tolerance:
                break
            m += 1
        out[n] = m
    return out


def survivors(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row i of a, row j of b) that no look at their MinHash values, or bytes of them, dropped."""
    found = np.zeros(len(i), np.int32)
    for n, least in needed(s).items():
        part = slice(n - s.step, n)
        found += (a[i, part] == b[j, part]).sum(axis=1, dtype=np.int32)
        stay = found >= least
        i, j, found = i[stay], j[stay], found[stay]
    return i, j


def sharing(sig: np.ndarray, i: np.ndarray, j: np.ndarray, s: Settings) -> np.ndarray:
    """Which pairs share a band."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        out[at : at + len(a)] = (sig[a] == sig[b]).reshape(len(a), s.bands, s.rows).all(axis=2).any(axis=1)
    return out


def linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Which pairs of sets have a Jaccard index of at least threshold, exactly."""
    size = np.array([len(x) for x in sets], np.int64)
    p, q = threshold.numerator, threshold.denominator
    shared = np.zeros(len(i), np.int64)
    if len(i) > 64:
        names, at = np.unique(np.concatenate(sets), return_inverse=True)
        if len(names) * len(sets) <= 24_000_000:
            m = np.zeros((len(sets), len(names)), np.float32)
            m[np.repeat(np.arange(len(sets)), size), at] = 1
            both = np.rint(m @ m.T).astype(np.int64)
            shared = both[i, j]
            return (p + q) * shared >= p * (size[i] + size[j])
    for k, (x, y) in enumerate(zip(i, j, strict=True)):
        if p * max(size[x], size[y]) <= q * min(size[x], size[y]):
            shared[k] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
    return (p + q) * shared >= p * (size[i] + size[j])


def _meet(s: Settings):
    """Members of some buckets or pairs of their chunks (unit): the pairs that survive, as (node, root) of what they connect."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(np.lexsort((rows["node"].to_numpy(), rows["unit"].to_numpy())))
        unit, node, mine, low, high = (rows[c].to_numpy() for c in ("unit", "node", "mine", "low", "high"))
        sig = np.stack([np.frombuffer(x.as_py(), np.uint8) for x in rows["small"]])
        edge = np.r_[0, np.flatnonzero(unit[1:] != unit[:-1]) + 1, len(unit)].tolist()
        out: list[tuple[np.ndarray, np.ndarray]] = []
        first: list[np.ndarray] = []
        second: list[np.ndarray] = []
        size = 0

        def look() -> None:
            nonlocal size
            i, j = survivors(sig, sig, np.concatenate(first), np.concatenate(second), s)
            # what the pairs connect, as the pairs of large groups of near copies are many
            names, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            out.append((node[names], node[names[roots(len(names), at[: len(i)], at[len(i) :])]]))
            first.clear()
            second.clear()
            size = 0

        for a, b in zip(edge, edge[1:], strict=False):
            if low[a] == high[a]:
                i, j = _triangle(b - a)
            else:
                i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(mine[a:b] == low[a]), np.flatnonzero(mine[a:b] == high[a]), indexing="ij"))
            if len(i):
                first.append(i + a)
                second.append(j + a)
                size += len(i)
                if size > 1 << 18:
                    look()
        if size:
            look()
        i, j = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        names, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        root = roots(len(names), at[: len(i)], at[len(i) :])
        return pa.table([names, names[root]], schema=schema)

    return run, "node long, root long"


@lru_cache(maxsize=64)
def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _compare(s: Settings):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        node = rows["node"].to_numpy()
        order = np.argsort(node, kind="stable")
        order = order[np.r_[True, node[order][1:] != node[order][:-1]]]  # repeated rows of a representative
        node = node[order]
        mine, low, high = (rows[c].to_numpy()[order] for c in ("mine", "low", "high"))
        sig = np.stack([np.frombuffer(x.as_py(), np.uint32) for x in rows["sig"].take(order)])
        i, j = (np.triu_indices(len(node), 1) if low[0] == high[0] else np.meshgrid(np.flatnonzero(mine == low), np.flatnonzero(mine == high), indexing="ij"))
        i, j = survivors(sig, sig, i.ravel(), j.ravel(), s)
        both = sharing(sig, i, j, s)
        i, j = i[both], j[both]
        weight = rows["weight"].to_numpy()[order]
        links = np.zeros(len(node), np.int64)
        if len(i):
            used = np.unique(np.concatenate([i, j]))
            grams_ = rows["grams"].take(order[used])
            good = linked([np.frombuffer(x.as_py(), np.uint64) for x in grams_], np.searchsorted(used, i), np.searchsorted(used, j), s.threshold)
            i, j = i[good], j[good]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
        some = np.flatnonzero(links)
        return pa.table([node[some], links[some], node[roots(len(node), i, j)][some]], schema=schema)

    return run, "node long, links long, root long"


def sketches(docs: DataFrame, s: Settings, text: str = "text") -> DataFrame:
    """doc_id, th (a hash of the text), k1 and k2 (a digest of the n-gram set), grams (their number), sig (MinHash values) and small
    (the low byte of each)."""

    def make():
        a, b = _coefficients(s)

        def one(t: str | None) -> tuple:
            g = grams(t, s.n)
            d = xxhash.xxh3_128_digest(g.tobytes())
            k1, k2 = np.frombuffer(d, np.int64).tolist()
            sig = minhash(g, a, b)
            return k1, k2, len(g), sig.tobytes(), sig.astype(np.uint8).tobytes()

        def each(r: dict[str, list]) -> dict[str, list]:
            k1, k2, n, sig, small = map(list, zip(*map(one, r["text"]), strict=True))
            return {"doc_id": r["doc_id"], "th": r["th"], "k1": k1, "k2": k2, "grams": n, "sig": sig, "small": small}

        return each

    return map_slices(docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("th")), make, "doc_id long, th long, k1 long, k2 long, grams int, sig binary, small binary")


def join(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, class_id, n_links (other documents linked directly), class_size."""
    return _join(docs, s, text).drop("th")


def representatives(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """One row of docs for each class, that of the class's id. Rows without an id are freed of exact copies only."""
    found = spill(_join(docs, s, text), "jaccard-found")
    known = found.filter(F.col("doc_id") == F.col("class_id")).groupBy("doc_id").agg(F.min("th").alias("th"))
    stay = known.union(found.filter("doc_id is null and class_id is null").select("doc_id", "th").distinct())
    stay = spill(stay.withColumnsRenamed({"doc_id": "_nf_doc", "th": "_nf_id"}), "jaccard-stay")
    out = docs.withColumn("_nf_th", F.xxhash64(text)).join(stay.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_nf_doc")) & (F.col("_nf_th") == F.col("_nf_id")), "left_semi")
    if found.groupBy("doc_id", "th").count().filter("count > 1").head(1):  # repeated rows
        out = out.dropDuplicates(["doc_id", "_nf_th"])
    return out.drop("_nf_th")


def _join(docs: DataFrame, s: Settings, text: str) -> DataFrame:
    each = spill(sketches(docs, s, text), "jaccard-sketches")
    classes = each.filter("grams > 0").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "th", "sig", "small")).alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("weight"))
    classes = spill(classes.select("k1", "k2", "first.*", "least", "weight", F.monotonically_increasing_id().alias("node")), "jaccard-classes")
    band = F.explode(F.sequence(F.lit(0), F.lit(s.bands - 1))).alias("band")
    bands = classes.select("node", "sig", band).select("node", F.xxhash64("band", F.substring("sig", F.col("band") * (4 * s.rows) + 1, F.lit(4 * s.rows))).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("chunks", F.ceil(F.col("n") / s.bucket).cast("int"))
    shared = spill(shared, "jaccard-bands")
    parts = max(1, -(-(shared.agg(F.sum(F.col("n") * F.col("chunks"))).first()[0] or 0) // s.dealt))
    met = bands.join(shared, "key").withColumn("mine", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
    met = met.withColumn("unit", F.xxhash64("key", "low", "high")).join(classes.select("node", "small"), "node")
    run, schema = _meet(s)
    edges = met.select(F.pmod("unit", F.lit(parts)).alias("part"), "unit", "node", "mine", "low", "high", "small").groupBy("part").applyInArrow(run, schema)
    sets = components(edges.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sizes = spill(sets.groupBy("component").count().withColumn("chunks", F.ceil(F.col("count") / s.chunk).cast("int")).drop("count"), "jaccard-sizes")
    members = sets.join(sizes, "component").withColumnRenamed("id", "node").withColumn("mine", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    members = spill(members.join(classes.select("node", F.col("doc_id").alias("doc_id_"), F.col("th").alias("th_"), "weight", "sig"), "node"), "jaccard-members")
    texts = docs.select("doc_id", F.col(text).alias("text")).withColumn("th", F.xxhash64("text"))
    full = texts.join(members, (texts.th == members.th_) & texts.doc_id.eqNullSafe(members.doc_id_)).select("node", "component", "chunks", "mine", "weight", "sig", "text")

    def make():
        return lambda r: {c: r[c] for c in ("node", "component", "chunks", "mine", "weight", "sig")} | {"grams": [grams(t, s.n).tobytes() for t in r["text"]]}

    full = map_slices(full, make, "node long, component long, chunks int, mine int, weight long, sig binary, grams binary")
    pairs = full.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
    run, schema = _compare(s)
    found = spill(pairs.select("component", "low", "high", "node", "mine", "weight", "sig", "grams").groupBy("component", "low", "high").applyInArrow(run, schema), "jaccard-links")
    tied = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = spill(found.groupBy("node").agg(F.sum("links").alias("links")), "jaccard-counts")
    known = classes.select("k1", "k2", "node", "least", "weight").join(tied.withColumnRenamed("id", "node"), "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = spill(known, "jaccard-known")
    whole = spill(known.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("weight").alias("class_size")), "jaccard-wholes")
    result = spill(known.join(whole, "component").select(F.col("k1").alias("k1_"), F.col("k2").alias("k2_"), "class_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "class_size"), "jaccard-result")
    back = each.select("doc_id", "th", "k1", "k2", "grams").join(result, (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_")), "left")
    alone = F.col("grams") == 0
    return back.select("doc_id", "th", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"))
