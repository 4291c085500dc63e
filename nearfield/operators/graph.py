"""Neighbour graphs as edge tables (src, dst, distance): building, pruning, searching, components.

An edge table is built by neighbour-of-neighbour descent or exactly; search expands a frontier of all queries at once,
one join a hop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.errors import InvalidArgument
from nearfield.functions import distance as D
from nearfield.operators.search import candidates, collected, direct, matrix, parts, ranked
from nearfield.sources.store import checkpointed

#: Queries that walk at a time.
WALKS = 1 << 14


def exact_edges(base: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Each row's k nearest others; the base is its own query set, in blocks."""
    found = candidates(base, base.filter("vector is not null").select(F.col("id").alias("qid"), F.col("vector").alias("q")), metric, k + 1).filter("qid <> id")
    return checkpointed(ranked(found, k).select(F.col("qid").alias("src"), F.col("id").alias("dst"), "rank", "distance"))


def by_group(rows: DataFrame, key: str, run: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run over all groups of equal keys, many small ones at a time: (a batch of whole groups, where each starts, and the batch's end)."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if held and (last or held[0].column(0)[0].as_py() != keys[0]):
                yield from whole([*held, batch.slice(0, last)])
                held = []
            elif last:
                yield from whole([batch.slice(0, last)])
            held.append(batch.slice(last))
        if held:
            yield from whole(held)

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        keys = batch.column(0).to_numpy()
        yield from run(batch, np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]))

    return rows.select(key, *[c for c in rows.columns if c != key]).repartition(key).sortWithinPartitions(key).mapInArrow(every, schema)


EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("distance", pa.float64())])


def _met(rows: DataFrame, metric: str) -> DataFrame:
    """(src, dst, distance) of rows (cell, id, vector, cut, asks, offered) that meet in a cell: each that asks with all that are offered,
    nearer than its cut. Vectors come once for each cell, not for each pair."""

    def run(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, x, cut, asks, offered = batch.column(1).to_numpy(), matrix(batch.column(2)), batch.column(3).to_numpy(), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
        a, b, waits = [], [], 0

        def measured() -> pa.RecordBatch:
            i, j = np.concatenate(a), np.concatenate(b)
            d = np.concatenate([direct(x[i[at : at + 4096]], x[j[at : at + 4096]], metric) for at in range(0, len(i), 4096)])
            with np.errstate(invalid="ignore"):
                good = np.isfinite(d) & (d <= cut[i])
            return pa.RecordBatch.from_arrays([ids[i[good]], ids[j[good]], d[good]], schema=EDGES)

        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            mine, theirs = lo + np.flatnonzero(asks[lo:hi]), lo + np.flatnonzero(offered[lo:hi])
            for at in range(0, len(mine) if len(theirs) else 0, step := max(1, (1 << 16) // max(1, len(theirs)))):
                i, j = np.repeat(mine[at : at + step], len(theirs)), np.tile(theirs, len(mine[at : at + step]))
                other = ids[i] != ids[j]
                a.append(i[other])
                b.append(j[other])
                if (waits := waits + len(i)) > 1 << 16:
                    yield measured()
                    a, b, waits = [], [], 0
        if waits:
            yield measured()

    rows = rows.select("cell", "id", "vector", F.coalesce("cut", F.lit(float("inf"))).alias("cut"), "asks", "offered")
    return by_group(rows, "cell", run, "src long, dst long, distance double")


def _closest(edges: DataFrame, k: int) -> DataFrame:
    """Each src's k nearest; an edge that is there several times counts once. One exchange by src serves both."""
    once = edges.repartition("src").groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("src", "dst", "distance")


def descent(base: DataFrame, k: int = 10, rounds: int = 6, sample: int = 10, metric: str = "l2", seed: int = 42) -> DataFrame:
    """Approximate k-neighbour edges: random ones first, then in each round a node meets the neighbours of at most
    `sample` of its neighbours, in both directions. Work a round is rows * sample^2, whatever the degrees; those who have a neighbour
    in common meet there, so what is shuffled are rows * sample * 2 vectors, not a vector a pair."""
    D.distance(metric)
    vectors = checkpointed(base.filter("vector is not null").select("id", "vector"))
    # k arbitrary partners: rows joined within small groups of equal hash, several times
    n = vectors.count()
    every = F.lit(None).cast("double").alias("cut"), F.lit(True).alias("asks"), F.lit(True).alias("offered")
    first = []
    for turn in range(max(2, k // 4)):
        cell = F.pmod(F.xxhash64(F.lit(seed + turn), "id"), F.lit(max(1, n // 8)))
        first.append(_met(vectors.select(cell.alias("cell"), "id", "vector", *every), metric))
    edges = checkpointed(_closest(reduce(DataFrame.union, first), k))
    for turn in range(rounds):
        both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).repartition("src").distinct()
        pick = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(turn), "src", "dst"))
        few = both.withColumn("_n", F.row_number().over(pick)).filter(F.col("_n") <= sample).drop("_n")
        # a node's few neighbours are offered at it to all whose few it is among
        few = checkpointed(few)
        at = few.select(F.col("src").alias("cell"), F.col("dst").alias("id"), F.lit(False).alias("asks"), F.lit(True).alias("offered"))
        at = at.union(few.select(F.col("dst").alias("cell"), F.col("src").alias("id"), F.lit(True).alias("asks"), F.lit(False).alias("offered")))
        at = at.repartition("id").groupBy("id", "cell").agg(F.max("asks").alias("asks"), F.max("offered").alias("offered"))
        far = edges.groupBy(F.col("src").alias("id")).agg(F.when(F.count("*") >= k, F.max("distance")).alias("cut"))
        met = _met(at.join(vectors.join(far, "id", "left"), "id"), metric)
        edges = checkpointed(_closest(edges.union(met), k))
    return edges


def pruned(base: DataFrame, edges: DataFrame, degree: int, alpha: float = 1.2, metric: str = "l2") -> DataFrame:
    """Occlusion: nearest first, an edge to c stays unless a kept s has alpha * d(s, c) < d(src, c)."""
    if metric not in ("l2", "ip", "cosine"):
        raise InvalidArgument(metric)
    rows = edges.join(base.select(F.col("id").alias("dst"), "vector"), "dst").select("src", "dst", "distance", "vector")

    def run(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        src, dst, d = (batch.column(i).to_numpy() for i in range(3))
        sizes = np.diff(starts)
        for size in np.unique(sizes):  # groups of one size side by side
            step = max(1, (1 << 21) // (int(size) * 64 * int(size)))
            of = starts[:-1][sizes == size]
            for lo in range(0, len(of), step):
                at = of[lo : lo + step, None] + np.arange(size)
                at = np.take_along_axis(at, np.lexsort((dst[at], d[at]), axis=1), 1)
                x, far = matrix(batch.column(3).take(pa.array(at.ravel()))).reshape(*at.shape, -1), d[at]
                kept = np.zeros(at.shape, bool)
                for i in range(int(size)):
                    them = np.broadcast_to(x[:, i : i + 1], x[:, :i].shape).reshape(-1, x.shape[2])
                    between = direct(x[:, :i].reshape(-1, x.shape[2]), them, metric).reshape(len(at), i)
                    with np.errstate(invalid="ignore"):
                        hidden = (kept[:, :i] & (alpha * between < far[:, i : i + 1])).any(axis=1)
                    kept[:, i] = ~hidden & (kept.sum(axis=1) < degree)
                stay = at[kept]
                yield pa.RecordBatch.from_arrays([src[stay], dst[stay], d[stay]], schema=EDGES)

    return by_group(rows, "src", run, "src long, dst long, distance double")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "distance").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).distinct()


def search(base: DataFrame, edges: DataFrame, queries: DataFrame, k: int, beam: int = 40, hops: int = 12, entry: int = 8, metric: str = "l2", where=None, among: DataFrame | None = None) -> DataFrame:
    """Frontier expansion for all queries: from `entry` rows, each hop scores the neighbours of the best `beam`
    rows and keeps the best beam. A filter (where, or the ids of among) limits what is returned, not what is walked through.

    What is kept of a query are its best rows, and its best that pass: what falls out of both is never among them again."""
    if beam < 1:
        raise InvalidArgument("beam must be at least 1")
    D.distance(metric)
    vectors = base.filter("vector is not null").select("id", "vector", (F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias("ok"))
    if among is not None:
        passing = among.select("id", F.lit(True).alias("_in")).distinct()
        vectors = vectors.join(passing, "id", "left").select("id", "vector", (F.col("ok") & F.coalesce("_in", F.lit(False))).alias("ok"))
    near = edges.groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("near"))
    vectors, near = checkpointed(vectors), checkpointed(near)
    starts = vectors.orderBy(F.xxhash64("id")).limit(entry).select("id")
    every, most = queries.select("qid", "q"), max(beam, k)
    split = parts(every, WALKS)
    spark, out = base.sparkSession, []
    for part in split:
        qids, q = collected(part)
        if not len(qids):
            continue
        cut = np.full((2, len(qids)), np.inf)
        seen, pairs = None, F.broadcast(starts).join(part.select("qid"))
        for hop in range(hops + 1):
            sent = spark.sparkContext.broadcast((qids, q, cut))  # at most WALKS vectors

            def run(batches: Iterator[pa.RecordBatch], sent=sent, hop=hop) -> Iterator[pa.RecordBatch]:
                qids, q, cut = sent.value
                for batch in batches:
                    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False))
                    at = np.searchsorted(qids, batch.column(3).flatten().to_numpy())
                    ids, x, ok = batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
                    for lo in range(0, len(row), 4096):
                        i, j = row[lo : lo + 4096], at[lo : lo + 4096]
                        d = direct(x[i], q[j], metric)
                        with np.errstate(invalid="ignore"):
                            good = np.isfinite(d) & ((d <= cut[0, j]) | (ok[i] & (d <= cut[1, j])))
                        i, j = i[good], j[good]
                        yield pa.RecordBatch.from_arrays([qids[j], ids[i], d[good], np.full(len(i), hop, np.int32), ok[i]], names=["qid", "id", "distance", "hop", "ok"])

            asked = vectors.join(pairs.groupBy("id").agg(F.collect_set("qid").alias("qids")), "id").select("id", "vector", "ok", "qids")
            new = asked.mapInArrow(run, "qid long, id long, distance double, hop int, ok boolean")
            once = (new if seen is None else seen.union(new)).repartition("qid").groupBy("qid", "id").agg(F.min("hop").alias("hop"), F.min("distance").alias("distance"), F.first("ok").alias("ok"))
            order = Window.partitionBy("qid").orderBy("distance", "id")
            of_ok = F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
            kept = once.withColumns({"rank": F.row_number().over(order), "ok_rank": of_ok}).filter((F.col("rank") <= most) | (F.col("ok") & (F.col("ok_rank") <= k)))
            state = checkpointed(kept)
            seen = state.select("qid", "id", "distance", "hop", "ok")
            top = state.filter((F.col("rank") <= beam) & (F.col("hop") == hop))
            if not top.head(1):
                break
            for i, full in enumerate((F.col("rank") == most, F.col("ok") & (F.col("ok_rank") == k))):
                last = state.filter(full).select("qid", "distance").toArrow()  # one a query
                cut[i, np.searchsorted(qids, last["qid"].to_numpy())] = last["distance"].to_numpy()
            pairs = top.select("qid", "id").join(near, "id").select("qid", F.explode("near").alias("id"))
        out.append(state.filter(F.col("ok") & (F.col("ok_rank") <= k)).select("qid", F.col("ok_rank").cast("int").alias("rank"), "id", "distance"))
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], "qid long, rank int, id long, distance double")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the least id connected to each, by minimum labels and their pointers."""
    e = checkpointed(undirected(edges).select("src", "dst"))
    label = checkpointed(e.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("component")).select(F.col("src").alias("id"), "component"))
    for _ in range(rounds):
        near = e.join(label.select(F.col("id").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("_least"))
        new = label.join(near, label.id == near.src, "left").select("id", F.least("component", "_least").alias("component"))
        jump = new.select(F.col("id").alias("_id"), F.col("component").alias("_up"))
        new = checkpointed(new.join(jump, new.component == jump._id, "left").select("id", F.least("component", "_up").alias("component")))
        if not new.exceptAll(label).head(1):
            return new
        label = new
    raise RuntimeError("components did not settle")


def degree_stats(edges: DataFrame) -> DataFrame:
    """(id, degree_out, degree_in)."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree_out"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree_in"))
    return out.join(into, "id", "full").select("id", F.coalesce("degree_out", F.lit(0)).alias("degree_out"), F.coalesce("degree_in", F.lit(0)).alias("degree_in"))


def duplicates(base: DataFrame) -> DataFrame:
    """(id, first_id, n): rows whose vector occurs more than once, with the least id of the group."""
    groups = base.filter("vector is not null").groupBy("vector").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.collect_list("id").alias("ids")).filter("n > 1")
    return groups.select(F.explode("ids").alias("id"), "first_id", "n")


def export_cache(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges between source ids, which outlive an index: sources has (id, source_id)."""
    a = sources.select(F.col("id").alias("src"), F.col("source_id").alias("src_source"))
    b = sources.select(F.col("id").alias("dst"), F.col("source_id").alias("dst_source"))
    return edges.join(a, "src").join(b, "dst").select("src_source", "dst_source", "distance")


def import_cache(cache: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges of a rebuilt index whose both ends were known before."""
    a = sources.select(F.col("id").alias("src"), F.col("source_id").alias("src_source"))
    b = sources.select(F.col("id").alias("dst"), F.col("source_id").alias("dst_source"))
    return cache.join(a, "src_source").join(b, "dst_source").select("src", "dst", "distance")
