"""Near-duplicate vectors within a label by search in a robust-pruned flat graph.

Equal vectors of a label become one node with a weight. Nodes of a label are split by spherical k-means, fitted on a
bounded sample of each cell, into cells that overlap: each node goes to its nearest centroids. Cells that are still
too large are split again. In each cell a graph is built: a node's nearest candidates, thinned by robust pruning
(a candidate goes if a kept one is nearer to it, by a factor, than the node), and the reverse edges. A node's
adjacency lists from all of its cells are united. Every node then searches each of its cells: a greedy beam from the
medoids, which expands on through all nodes within a margin of the threshold; the walks of many nodes advance together,
as array operations. Hits are verified by the cosine in double precision. A pair that lies in several cells counts in
the least of them, so a task returns sums and roots, never pairs. A cell has a bounded size, so the work for a node does
not grow with the table, but for the levels of splits (one for each factor of some hundred rows of a label).

A split is measured on its sample: the share of links whose ends still meet in a cell. Cells that lose too many at
every overlap tried (tight groups, which k-means cuts at random) are not split but compared block by block, exactly.
An audit compares some nodes' links, drawn by how many they have, with brute force over all nodes; below the required
recall the beam and the overlap are raised, and if that does not do, all labels are compared block by block. The recall
that the audit found is a column of the result.

Rows whose label or vector is null, and vectors that are empty, zero or hold null or non-finite components, link with
nothing. Vectors of other lengths are never compared. Repeated rows are equal vectors; a repeated vec_id with other
vectors is several nodes. Vectors at the threshold itself link. component_id is the smallest vec_id of a component, null
if all are null. An empty table gives an empty result. Other columns than vec_id, embedding and label are not looked at.
What is drawn depends on the vectors only, so that reruns agree however the rows are dealt.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import map_slices, spill, unit_hash
from nearfield.llm.components import components, roots


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.93
    #: Cells a node goes to at each split, how many nodes a cell may have before it is split, and about how many then.
    overlap: int = 2
    cell: int = 700
    target: int = 400
    #: Most centroids of a split, and nodes it is fitted on: so many, and so many for each centroid.
    centres: int = 512
    sample: int = 4096
    each: int = 32
    levels: int = 8
    #: Share of a cell's nodes up to which its parts are parts.
    parted: float = 0.7
    candidates: int = 48
    degree: int = 24
    #: Edges to arbitrary nodes of the cell, and medoids at which a search starts.
    far: int = 3
    medoids: int = 24
    alpha: float = 1.2
    beam: int = 24
    margin: float = 0.04
    #: Walks that advance together.
    walks: int = 256
    audit: int = 256
    recall: float = 0.97
    #: Rounds of search, each with more effort, before all is compared exactly; nodes in a block of exact comparison, and of a
    #: task that deals out a cell.
    rounds: int = 3
    block: int = 4096
    dealt: int = 8192


#: Edges followed at a time.
EDGES = 1 << 19


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from points spread by farthest-first among a few."""
    rng = np.random.default_rng(len(x))
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def prune(x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency of all rows (from, to), sorted: robust pruning of each row's nearest candidates, and reverse edges."""
    n = len(x)
    m = min(s.candidates, n - 1)
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sources, targets = [], []
    for at in range(0, n, 256):
        sim = x[at : at + 256] @ x.T
        sim[np.arange(len(sim)), np.arange(at, at + len(sim))] = -2
        near = np.argpartition(-sim, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1)
        own = 1 - np.take_along_axis(sim, near, 1)
        points = x[near]
        between = 1 - points @ points.transpose(0, 2, 1)
        alive, kept = np.ones(near.shape, bool), np.zeros(near.shape, bool)
        for j in range(m):
            take = alive[:, j] & (kept.sum(axis=1) < s.degree)
            kept[take, j] = True
            alive[take] &= s.alpha * between[take, j] > own[take]
            alive[:, j] = False
        row, column = np.nonzero(kept)
        sources.append(at + row)
        targets.append(near[row, column])
    # far edges and a ring, so that a tight group whose members are all each other's nearest can be reached
    sources += [np.repeat(np.arange(n), s.far), np.arange(n)]
    targets += [np.random.default_rng(n).integers(0, n, n * s.far), np.roll(np.arange(n), 1)]
    a, b = np.concatenate(sources), np.concatenate(targets)
    both = np.unique(np.concatenate([a * n + b, b * n + a])[np.tile(a != b, 2)])
    return both // n, both % n


def search(x: np.ndarray, starts: np.ndarray, targets: np.ndarray, medoids: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(row, hit): for every row the rows met whose similarity is about the threshold or more. starts: where a row's part of
    targets begins, and the end. All rows of a batch take a step at a time: those with unexpanded nodes within the margin of
    the threshold expand all of these, the others the best few of their beam."""
    n, unseen = len(x), np.float32(-4)
    degree = np.diff(starts)
    reach = s.threshold - s.margin
    rows, hits = [], []
    for at in range(0, n, s.walks):
        q = x[at : at + s.walks]
        sims = np.full((len(q), n), unseen, np.float32)
        sims[:, medoids] = q @ x[medoids].T
        done = np.zeros(sims.shape, bool)
        active = np.arange(len(q))
        while len(active):
            now = sims[active]
            cut = np.partition(now, n - s.beam, axis=1)[:, n - s.beam] if n > s.beam else np.full(len(now), unseen)
            go = ~done[active] & (now > unseen) & ((now >= cut[:, None]) | (now >= reach))
            some = go.any(axis=1)
            active, now, go = active[some], now[some], go[some]
            if not len(active):
                break
            near = go & (now >= reach)
            best = np.where(go, now, unseen)
            fourth = np.partition(best, n - 4, axis=1)[:, n - 4] if n > 4 else np.full(len(best), unseen)
            take = np.where(near.any(axis=1)[:, None], near, go & (best >= fourth[:, None]))
            i, j = np.nonzero(take)
            done[active[i], j] = True
            fresh = np.zeros(take.shape, bool)
            size = degree[j]
            ends = np.cumsum(size)
            bound = np.searchsorted(ends, np.arange(0, ends[-1] + EDGES, EDGES), side="right")
            for a, b in zip(bound, bound[1:], strict=False):  # all of a tight group may be expanded at once
                part = size[a:b]
                edge = np.repeat(starts[j[a:b]] - (np.cumsum(part) - part), part) + np.arange(part.sum())
                fresh[np.repeat(i[a:b], part), targets[edge]] = True
            i, j = np.nonzero(fresh & (now == unseen))
            for k in range(0, len(i), 1 << 16):
                a, b = active[i[k : k + (1 << 16)]], j[k : k + (1 << 16)]
                sims[a, b] = np.einsum("ij,ij->i", q[a], x[b])
        i, j = np.nonzero(sims >= s.threshold - 1e-3)
        apart = i + at != j
        rows.append(i[apart] + at)
        hits.append(j[apart])
    return np.concatenate(rows), np.concatenate(hits)


def _vectors(block: pa.Table) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_py(), np.float64) for v in block["vector"]])


def _ordered(block: pa.Table) -> pa.Table:
    """In an order that depends on the vectors, as draws follow it."""
    return block.take(np.lexsort((block["node"].to_numpy(), block["h"].to_numpy())))


def _fit(s: Settings):
    schema = pa.schema([("cell", pa.int64()), ("centres", pa.binary()), ("overlap", pa.int32())])

    def run(block: pa.Table) -> pa.Table:
        x = unit(_vectors(_ordered(block))).astype(np.float32)
        c = centroids(x, block["k"][0].as_py())
        # the least overlap, of three, at which nearly all links of the sample keep a common cell
        near = np.argsort(-(x @ c.T), axis=1, kind="stable")
        tried = range(s.overlap, s.overlap + 3)
        member = []
        for overlap in tried:
            member.append(np.zeros((len(x), len(c)), np.float32))
            np.put_along_axis(member[-1], near[:, :overlap], 1, axis=1)
        links, met = 0, [0] * len(member)
        for at in range(0, len(x), 256):
            i, j = np.nonzero(x[at : at + 256] @ x.T >= s.threshold)
            i, j = (v[i + at < j] for v in (i, j))
            links += len(i)
            for o, m in enumerate(member):
                for k in range(0, len(i), 1 << 14):
                    met[o] += np.count_nonzero((m[at + i[k : k + (1 << 14)]] * m[j[k : k + (1 << 14)]]).any(axis=1))
        enough = [n >= links * (1 + s.recall) / 2 for n in met]
        # a split whose largest cell keeps most of the nodes separates nothing
        overlap = next((o for o, fine, m in zip(tried, enough, member, strict=True) if fine and m.sum(axis=0).max() <= s.parted * len(x)), 0)
        return pa.table([[block["cell"][0].as_py()], [c.astype(np.float32).tobytes() if overlap else None], [overlap]], schema=schema)

    return run, "cell long, centres binary, overlap int"


def _deal(s: Settings, level: int):
    """The cells that some nodes of a cell go to; one row without a node brings the centroids."""
    schema = pa.schema([("node", pa.int64()), ("h", pa.int64()), ("cell", pa.int64()), ("vector", pa.binary())])

    def run(block: pa.Table) -> pa.Table:
        cell = block["cell"][0].as_py()
        model = block.filter(pa.compute.is_null(block["node"]))
        nodes = block.filter(pa.compute.is_valid(block["node"]))
        centres, overlap = (model["vector"][0].as_py(), model["overlap"][0].as_py()) if len(model) else (None, 0)
        if not len(nodes) or centres is None:
            return nodes.select(schema.names).cast(schema)
        x = unit(_vectors(nodes)).astype(np.float32)
        near = np.argsort(-(x @ np.frombuffer(centres, np.float32).reshape(-1, x.shape[1]).T), axis=1, kind="stable")[:, :overlap]
        names = np.array([hash((cell, level, i)) for i in range(near.max() + 1)], np.int64)
        out = nodes.select(schema.names).take(np.repeat(np.arange(len(nodes)), near.shape[1]))
        return out.set_column(2, "cell", pa.array(names[near].ravel())).cast(schema)

    return run, "node long, h long, cell long, vector binary"


def split(nodes: DataFrame, s: Settings, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(node, h, cell, vector) of every cell that a node belongs to, and (cell, blocks) of cells to compare block by block; exact: all."""
    each = nodes.select("node", "h", F.xxhash64("label", F.length("vector")).alias("cell"), "vector")
    whole = nodes.sparkSession.createDataFrame([], "cell long")
    for level in range(s.levels + 1):
        sizes = each.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > (1 if exact else s.cell)).join(whole, "cell", "left_anti")
        k = F.least(F.lit(s.centres), F.greatest(F.lit(2), F.ceil(F.col("n") * s.overlap / s.target))).cast("int")
        big = spill(sizes.withColumn("k", k).withColumn("parts", F.ceil(F.col("n") / s.dealt).cast("int")), "neardup-big")
        if not big.head(1):
            break
        if exact or level == s.levels:
            whole = whole.union(big.select("cell"))
            break
        share = F.greatest(F.lit(s.sample), F.col("k") * s.each) / F.col("n")
        drawn = each.join(big, "cell").filter(unit_hash("h", seed=f"cells{level}") < share).select("cell", "k", "node", "h", "vector")
        run, schema = _fit(s)
        fitted = spill(drawn.groupBy("cell").applyInArrow(run, schema), "neardup-centroids")
        whole = whole.union(fitted.filter("overlap = 0").select("cell"))
        moving = each.join(big.select("cell", "parts"), "cell").select("node", "h", "cell", "vector", F.lit(0).alias("overlap"), F.pmod(F.xxhash64(F.lit(level), "h"), "parts").cast("int").alias("part"))
        models = fitted.join(big.select("cell", "parts"), "cell").select(F.lit(None).cast("long").alias("node"), F.lit(0).cast("long").alias("h"), "cell", F.col("centres").alias("vector"), "overlap", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        run, schema = _deal(s, level)
        moved = moving.union(models).groupBy("cell", "part").applyInArrow(run, schema)
        each = spill(each.join(big.select("cell"), "cell", "left_anti").select("node", "h", "cell", "vector").union(moved), "neardup-cells")
    return each, each.join(whole, "cell").groupBy("cell").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))


def _build(s: Settings):
    schema = pa.schema([("node", pa.int64()), ("cell", pa.int64()), ("edges", pa.list_(pa.int64()))])

    def run(block: pa.Table) -> pa.Table:
        block = _ordered(block)
        node = block["node"].to_numpy()
        a, b = prune(unit(_vectors(block)).astype(np.float32), s)
        starts = np.searchsorted(a, np.arange(len(node) + 1)).astype(np.int32)
        return pa.table([node, np.full(len(node), block["cell"][0].as_py()), pa.ListArray.from_arrays(starts, pa.array(node[b], pa.int64()))], schema=schema)

    return run, "node long, cell long, edges array<long>"


def _lesser(block: pa.Table) -> np.ndarray:
    """Rows x lesser cells that two rows or more share: pairs that also meet in one of these count there."""
    cell = block["cell"][0].as_py()
    lists = block["cells"].combine_chunks()
    other, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(block)), lists.value_lengths().to_numpy())
    row, other = row[other < cell], other[other < cell]
    names, at, times = np.unique(other, return_inverse=True, return_counts=True)
    out = np.zeros((len(block), len(names)), np.float32)
    out[row, at] = 1
    return out[:, times > 1]


def _search(s: Settings):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(block: pa.Table) -> pa.Table:
        block = _ordered(block)
        node, weight = block["node"].to_numpy(), block["weight"].to_numpy()
        exact = unit(_vectors(block))
        x = exact.astype(np.float32)
        # edges within the cell, by place
        lists = block["edges"].combine_chunks()
        row, to = np.repeat(np.arange(len(node)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        by = np.argsort(node)
        at = by[np.minimum(np.searchsorted(node[by], to), len(node) - 1)]
        row, at = row[node[at] == to], at[node[at] == to]
        starts = np.searchsorted(row, np.arange(len(node) + 1))
        medoids = np.unique((centroids(x, s.medoids, 4) @ x.T).argmax(axis=1))
        i, j = search(x, starts, at, medoids, s)
        pair = np.unique(np.minimum(i, j) * len(node) + np.maximum(i, j))
        i, j = pair // len(node), pair % len(node)
        vectors, lesser = _vectors(block), _lesser(block)
        norm = np.linalg.norm(vectors, axis=1)
        good = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 14):
            a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            good[k : k + (1 << 14)] = (np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norm[a] * norm[b]) >= s.threshold) & ~(lesser[a] * lesser[b]).any(axis=1)
        i, j = i[good], j[good]
        links = np.zeros(len(node), np.int64)
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        root = roots(len(node), i, j)
        some = np.flatnonzero(links)
        return pa.table([node[some], links[some], node[root[some]]], schema=schema)

    return run, "node long, links long, root long"


def _compare(s: Settings):
    """All pairs between two blocks of a cell, or within one."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("node")
        node, weight, at_block = (block[c].to_numpy() for c in ("node", "weight", "block"))
        x, other = _vectors(block), _lesser(block)
        norm = np.linalg.norm(x, axis=1)
        lo, hi = block["lo"][0].as_py(), block["hi"][0].as_py()
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        left, right = np.flatnonzero(at_block == lo), np.flatnonzero(at_block == hi)
        for at in range(0, len(left), 256):
            a = left[at : at + 256]
            good = x[a] @ x[right].T / (norm[a, None] * norm[right]) >= s.threshold
            if other.shape[1]:
                good &= other[a] @ other[right].T == 0
            if lo == hi:
                good &= a[:, None] != right
            links[a] += good @ weight[right]
            if lo != hi:
                links[right] += good.T @ weight[a]
            for i, row in zip(a, good, strict=True):
                if row.any():
                    met = np.unique(np.append(root[right[row]], root[i]))
                    if len(met) > 1:
                        root[np.isin(root, met)] = met[0]
        some = np.flatnonzero(links)
        return pa.table([node[some], links[some], node[root[some]]], schema=schema)

    return run, "node long, links long, root long"


def _once(nodes: DataFrame, s: Settings, exact: bool = False) -> DataFrame:
    """(node, links, root) from each cell."""
    cells, whole = split(nodes, s, exact)
    cells, whole = spill(cells, "neardup-split"), spill(whole, "neardup-whole")
    searched = cells.join(whole, "cell", "left_anti")
    held = cells.groupBy("node").agg(F.collect_set("cell").alias("cells")).join(nodes.select("node", "weight"), "node")
    run, schema = _build(s)
    lists = searched.select("node", "h", "cell", "vector").groupBy("cell").applyInArrow(run, schema)
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))
    united = spill(united.join(held, "node"), "neardup-graph")
    run, schema = _search(s)
    found = searched.join(united, "node").select("cell", "node", "h", "vector", "weight", "edges", "cells").groupBy("cell").applyInArrow(run, schema)
    if whole.head(1):
        dealt = cells.join(whole, "cell").withColumn("block", F.pmod(F.xxhash64("h", "node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "to"), "hi": F.greatest("block", "to")})
        run, schema = _compare(s)
        found = found.union(dealt.join(held, "node").select("cell", "lo", "hi", "block", "node", "vector", "weight", "cells").groupBy("cell", "lo", "hi").applyInArrow(run, schema))
    return spill(found, "neardup-found")


def audit(nodes: DataFrame, found: DataFrame, s: Settings) -> float:
    """Links found of links there are, over all nodes of their labels, for some nodes of each number of links (by powers
    of two): the least such share over nodes with about as many true links, and over all; 1 if there are none."""
    counted = nodes.select("node", "h").join(found.groupBy("node").agg(F.sum("links").alias("got")), "node", "left")
    counted = spill(counted.select("node", "h", F.coalesce("got", F.lit(0)).alias("got")).withColumn("stratum", F.floor(F.log2(F.col("got") + 1)).cast("int")), "neardup-audit")
    sizes = {r.stratum: r["count"] for r in counted.groupBy("stratum").count().collect()}  # at most 64
    if not sizes:
        return 1.0
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, s.audit / len(sizes) / n)])
    drawn = counted.filter(unit_hash("h", seed="audit") < share[F.col("stratum")]).orderBy(unit_hash("h", seed="order")).limit(4 * s.audit)
    chosen = nodes.join(drawn.select("node", "got"), "node").select("node", "label", "vector", "got").collect()
    if not chosen:
        return 1.0
    sent = nodes.sparkSession.sparkContext.broadcast([(r.node, r.label, bytes(r.vector)) for r in chosen])  # at most 4 * audit vectors

    def make():
        by: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for key in {(label, len(vector)) for _, label, vector in sent.value}:
            mine = [(node, vector) for node, label, vector in sent.value if (label, len(vector)) == key]
            by[key] = np.array([n for n, _ in mine]), unit(np.stack([np.frombuffer(v, np.float64) for _, v in mine]))

        def each(r: dict[str, list]) -> dict[str, list]:
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(r["label"], map(len, r["vector"]), strict=True)):
                if key in by:
                    groups.setdefault(key, []).append(i)
            out: dict[str, list] = {"node": [], "links": []}
            for key, rows in groups.items():
                names, q = by[key]
                x = unit(np.stack([np.frombuffer(r["vector"][i], np.float64) for i in rows]))
                linked = (x @ q.T >= s.threshold) & (np.array([r["node"][i] for i in rows])[:, None] != names)
                links = np.array([r["weight"][i] for i in rows]) @ linked
                out["node"] += names[links > 0].tolist()
                out["links"] += links[links > 0].tolist()
            return out

        return each

    truth = {r.node: r.links for r in map_slices(nodes.select("node", "label", "vector", "weight"), make, "node long, links long").groupBy("node").agg(F.sum("links").alias("links")).collect()}
    there, got = np.zeros(65), np.zeros(65)
    for r in chosen:
        if n := truth.get(r.node, 0):
            there[n.bit_length()] += n
            got[n.bit_length()] += r.got
    enough = there >= 100  # fewer links say little by themselves
    return float(min([1.0, *(got[enough] / there[enough]), got.sum() / max(1, there.sum()) if there.sum() else 1.0]))


def link(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """A row for each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept, recall (as audited; 1 where
    all was compared)."""
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    value = lambda x: x.cast("double")
    fine = fine & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(value(x)) < float("inf"))) & F.exists("embedding", lambda x: value(x) != 0)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumn("embedding", F.when(F.col("fine"), F.transform("embedding", lambda x: x + F.lit(0.0))))
    rows = rows.withColumns({"v1": F.xxhash64("embedding"), "v2": F.xxhash64(F.lit("second"), "embedding")})
    groups = rows.filter("fine").groupBy("label", "v1", "v2").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.min("embedding").alias("embedding"))

    def pack():
        def scaled(v: list[float]) -> bytes:
            x = np.array(v, np.float64)
            return np.ldexp(x, -np.frexp(np.abs(x).max())[1]).tobytes()  # by a power of two, so that no square under- or overflows

        return lambda r: {c: r[c] for c in ("node", "h", "label", "v1", "v2", "least", "weight")} | {"vector": [scaled(v) for v in r["embedding"]]}

    label = vectors.schema["label"].dataType.simpleString()
    groups = groups.withColumns({"node": F.monotonically_increasing_id(), "h": F.xxhash64("label", "v1", "v2")})
    nodes = spill(map_slices(groups, pack, f"node long, h long, label {label}, v1 long, v2 long, least long, weight long, vector binary"), "neardup-nodes")
    for _ in range(s.rounds):
        found = _once(nodes, s)
        recall = audit(nodes, found, s)
        if recall >= s.recall:
            break
        s = replace(s, overlap=s.overlap + 1, beam=2 * s.beam, margin=s.margin * 1.5)
    else:
        found, recall = _once(nodes, s, exact=True), 1.0
    tied = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = spill(found.groupBy("node").agg(F.sum("links").alias("links")), "neardup-counts")
    known = nodes.select("node", F.col("label").alias("label_"), F.col("v1").alias("v1_"), F.col("v2").alias("v2_"), "least", "weight").join(tied.withColumnRenamed("id", "node"), "node", "left").join(counts, "node", "left")
    known = spill(known.withColumn("component", F.coalesce("component", "node")), "neardup-known")
    least = spill(known.groupBy("component").agg(F.min("least").alias("component_id")), "neardup-least")
    result = spill(known.join(least, "component").select("label_", "v1_", "v2_", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "neardup-result")
    on = F.col("fine") & (F.col("label") == F.col("label_")) & (F.col("v1") == F.col("v1_")) & (F.col("v2") == F.col("v2_"))
    out = rows.join(result, on, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("recall", F.lit(float(recall)))
