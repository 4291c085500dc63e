"""Exact search: top k, range, thresholds, pages, distances by id.

The base is a DataFrame with id and vector; a query set has qid and q. The query set is held in blocks of bounded
size: each task scores its Arrow batches against a block with one matrix product in single precision, which bounds distances from
below, computes those of what may be among the best directly in double precision, and keeps its best k for each query; a window limit merges
the tasks' candidates. So k rows a query and task are shuffled, whatever the base's size. Query sets too large for one plan are answered part by part, each
written before the next. Non-finite distances are never returned; ties go by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.errors import InvalidArgument
from nearfield.functions import distance as D
from nearfield.sources.store import checkpointed

#: Queries in a block, blocks that one plan may have, and tasks that score a block where there are many.
BLOCK, BLOCKS, SHARES = 4096, 16, 8


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def scored(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """rows x queries distances in double precision. Squared differences are summed directly, so equal vectors are at 0."""
    if metric == "ip":
        return 1 - x @ q.T
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - (x @ q.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None])
    if len(q) * x.shape[1] <= 4096:
        return ((x[:, None] - q[None]) ** 2).sum(axis=2)
    out = np.empty((len(x), len(q)))
    for j, v in enumerate(q):
        out[:, j] = ((x - v) ** 2).sum(axis=1)
    return out


def products(x: np.ndarray, q: np.ndarray, metric: str, square: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | float]:
    """rows x queries distances by one matrix product, and how far they may be from direct sums. square: squared lengths
    of rows, where they are not those of x."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        dot = x @ q.T
        if metric == "ip":
            return 1 - dot, 1e-12 * (np.abs(x).max(axis=1, initial=0)[:, None] * np.abs(q).max(axis=1, initial=0)[None] * x.shape[1] + 1)
        if metric == "cosine":
            return 1 - dot / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None]), 1e-12
        xx = np.einsum("ij,ij->i", x, x) if square is None else square
        qq = np.einsum("ij,ij->i", q, q)
        return xx[:, None] + qq[None] - 2 * dot, 1e-12 * (xx[:, None] + qq[None] + 1)


def direct(x: np.ndarray, q: np.ndarray, metric: str, square: np.ndarray | None = None) -> np.ndarray:
    """Distances of pairs of rows, each summed in the same order wherever it is computed."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        if metric == "l2" and square is None:
            return ((x - q) ** 2).sum(axis=1)
        dot = (x * q).sum(axis=1)
        if metric == "l2":
            return square + (q * q).sum(axis=1) - 2 * dot
        return 1 - dot if metric == "ip" else 1 - dot / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))


class Asked:
    """Queries of a block in double precision, and in single precision what gives lower bounds of their distances by one product."""

    def __init__(self, q: np.ndarray, metric: str) -> None:
        self.q, self.metric = q, metric
        self.share = (q.shape[1] + 8) * 2.0**-23  # of the squared lengths: how far single precision may be off
        with np.errstate(over="ignore", invalid="ignore"):
            self.plain = bool((np.einsum("ij,ij->i", q, q) < 1e30).all())
        self._of: dict[bool, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self._space = np.zeros((2, 0), np.float32), np.zeros((2, 0), bool)

    def space(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Where rows x queries bounds and comparisons go, the same memory for each batch."""
        if len(self._space[0]) < rows or self._space[0].shape[1] != len(self.q):
            self._space = np.empty((rows, len(self.q)), np.float32), np.empty((rows, len(self.q)), bool)
        return self._space[0][:rows], self._space[1][:rows]

    def side(self, centred: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries' side of the product, what is taken off all vectors before, and squared lengths."""
        if centred not in self._of:
            q, c = self.q, self.share
            if self.metric == "l2":
                mean = q.mean(axis=0) if centred and len(q) else np.zeros(q.shape[1])
                q = q - mean
                qq = np.einsum("ij,ij->i", q, q)
                side = np.concatenate([-2 * q, np.ones((len(q), 1)), (qq * (1 - c) - 1e-30)[:, None]], axis=1)
            elif self.metric == "ip":
                mean, qq = np.zeros(q.shape[1]), np.einsum("ij,ij->i", q, q)
                side = np.concatenate([-q, np.ones((len(q), 1)), (-c * qq)[:, None]], axis=1)
            else:
                mean, qq = np.zeros(q.shape[1]), np.ones(len(q))
                with np.errstate(invalid="ignore", divide="ignore"):
                    side = np.concatenate([-q / np.linalg.norm(q, axis=1, keepdims=True), np.ones((len(q), 1)), np.zeros((len(q), 1))], axis=1)
            self._of[centred] = np.ascontiguousarray(side.T, np.float32), mean, qq
        return self._of[centred]

    def bounds(self, x: np.ndarray, square: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """rows x queries lower bounds of distances, in single precision, and by how much upper bounds are above them, by query."""
        c, (side, mean, qq) = self.share, self.side(square is None)
        one = np.ones((len(x), 1))
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            xx = np.einsum("ij,ij->i", x, x)
            if self.metric == "l2":
                y = x - mean
                yy = np.einsum("ij,ij->i", y, y)
                mine = np.concatenate([y, ((yy if square is None else square) - c * (yy if square is None else np.maximum(yy, np.abs(square))))[:, None], one], axis=1)
                most = yy if square is None else np.maximum(yy, np.abs(square))
            elif self.metric == "ip":
                mine, most = np.concatenate([x, (1 - c - c * xx)[:, None], one], axis=1), xx + 1
            else:
                mine, most = np.concatenate([x / np.sqrt(xx)[:, None], np.full((len(x), 1), 1 - 2 * c), one], axis=1), np.ones(len(x))
            return np.matmul(mine.astype(np.float32), side, out=self.space(len(x))[0]), 2 * c * (most.max(initial=0) + qq + 1e-20)


def _true(flags: np.ndarray) -> np.ndarray:
    """Flat places of few true flags, looked for eight at a time."""
    flat = flags.reshape(-1)
    whole = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


class Best:
    """The best k ids of each query seen so far (None: all within radius). cut: distances beyond which a query's rows don't count.
    repeats: an id may come again, and counts once, at its least distance."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, queries: int, k: int | None, radius: float | None, cut: np.ndarray | None = None, repeats: bool = False) -> None:
        self.k, self.radius, self.repeats = k, radius, repeats
        self.cut = np.full(queries, np.inf if radius is None else radius) if cut is None else np.minimum(cut, np.inf if radius is None else radius)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        if k is not None:
            self.d, self.ids = np.full((queries, k), np.inf), np.full((queries, k), self.NONE)

    def add(self, ids: np.ndarray, x: np.ndarray, asked: Asked, which: np.ndarray, square: np.ndarray | None = None) -> None:
        """Rows against the queries of asked, whose numbers are which."""
        with np.errstate(over="ignore", invalid="ignore"):
            long = np.einsum("ij,ij->i", x, x)
            if not (there := np.isfinite(x).all(axis=1)).all():  # such rows have no finite distance
                ids, x, long, square = ids[there], x[there], long[there], None if square is None else square[there]
        if not len(x) or not len(which):
            return
        if not asked.plain or not (long < 1e30).all():
            low, off = products(x, asked.q, asked.metric, square)
            low, above = low - off, 2 * (off.max(axis=0) if isinstance(off, np.ndarray) else off) * np.ones(len(which))
        else:
            low, above = asked.bounds(x, square)
        with np.errstate(invalid="ignore", over="ignore"):
            if self.k is not None and len(x) > self.k and not self.repeats and len(open_ := np.flatnonzero(np.isinf(self.cut[which]))):
                kth = np.partition(np.where(np.isfinite(low[:, open_]), low[:, open_], np.inf), self.k - 1, axis=0)[self.k - 1]
                self.cut[which[open_]] = kth.astype(np.float64) + above[open_]
            cut = np.nextafter(self.cut[which].astype(low.dtype), np.array(np.inf, low.dtype))
            i, j = np.divmod(_true(np.less_equal(low, cut, out=asked.space(len(x))[1])), len(which))
        for at in range(0, len(i), 1 << 13):
            a, b = i[at : at + (1 << 13)], j[at : at + (1 << 13)]
            exact = direct(x[a], asked.q[b], asked.metric, None if square is None else square[a])
            with np.errstate(invalid="ignore"):
                good = np.isfinite(exact) & (exact <= self.cut[which[b]])
            self.give(which[b[good]], ids[a[good]], exact[good])

    def give(self, j: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        """Rows with their distances from the queries j."""
        self.new.append((j, ids, d))
        self.waiting += len(j)
        if self.k is not None and self.waiting > self.d.size // 2 + 1024:
            self._merge()

    def _merge(self) -> None:
        """Takes what waits among the best, for the queries that it concerns."""
        if not self.waiting:
            return
        j, ids, d = (np.concatenate(c) for c in zip(*self.new, strict=True))
        self.new, self.waiting = [], 0
        if self.repeats:
            by = np.lexsort((d, ids, j))
            j, ids, d = j[by], ids[by], d[by]
            first = np.concatenate([[True], (j[1:] != j[:-1]) | (ids[1:] != ids[:-1])])
            j, ids, d = j[first], ids[first], d[first]
        order = np.lexsort((ids, d, j))
        j, ids, d = j[order], ids[order], d[order]
        some, start = np.unique(j, return_index=True)
        rank = np.arange(len(j)) - np.repeat(start, np.diff(np.append(start, len(j))))
        keep = rank < self.k
        row, rank, ids, d = np.searchsorted(some, j[keep]), rank[keep], ids[keep], d[keep]
        more = (len(some), int(rank.max()) + 1)
        new_d, new_ids = np.full(more, np.inf), np.full(more, self.NONE)
        new_d[row, rank], new_ids[row, rank] = d, ids
        all_d, all_ids = np.concatenate([self.d[some], new_d], axis=1), np.concatenate([self.ids[some], new_ids], axis=1)
        if self.repeats:
            by = np.lexsort((all_d, all_ids), axis=1)
            all_d, all_ids = np.take_along_axis(all_d, by, 1), np.take_along_axis(all_ids, by, 1)
            again = np.zeros(all_ids.shape, bool)
            again[:, 1:] = all_ids[:, 1:] == all_ids[:, :-1]
            all_d[again], all_ids[again] = np.inf, self.NONE
        order = np.lexsort((all_ids, all_d), axis=1)[:, : self.k]
        self.d[some], self.ids[some] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_ids, order, 1)
        self.cut[some] = np.minimum(self.cut[some], self.d[some, -1])

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.k is None:
            out = tuple(np.concatenate(c) for c in zip(*self.new, strict=True)) if self.new else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            self.new, self.waiting = [], 0
            return out
        self._merge()
        j, at = np.nonzero(np.isfinite(self.d))
        return j, self.ids[j, at], self.d[j, at]


def parts(queries: DataFrame, most: int) -> list[DataFrame]:
    """The query set whole, or in parts of about so many, by hash of the id."""
    if queries.limit(most + 1).count() <= most:
        return [queries]
    written = checkpointed(queries)
    n = 2 * (-(-written.count() // most))
    return [written.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)]


def collected(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a query set that parts() has bounded, by id."""
    got = queries.select("qid", "q").toArrow()
    if not got.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    if got["q"].null_count:
        raise InvalidArgument("queries must not be null")
    if len(pc.unique(pc.list_value_length(got["q"]))) > 1:
        raise InvalidArgument("queries differ in length")
    qid, q = got["qid"].to_numpy(), matrix(got["q"].combine_chunks())
    order = np.argsort(qid, kind="stable")
    return qid[order].astype(np.int64), q[order]


ARROW = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])


def candidates(base: DataFrame, queries: DataFrame, metric: str, k: int | None, radius: float | None = None, vector: str = "vector", decode: Callable | None = None, cuts: DataFrame | None = None) -> DataFrame:
    """(qid, id, distance): for each query the task-wise best k, or all within radius. decode: from an Arrow column of codes to
    (matrix, squared lengths or None), so that a task reads codes and no vectors are made of them outside it. cuts: (qid, distance),
    beyond which rows of a query don't count."""
    D.distance(metric)
    spark = base.sparkSession
    schema = "qid long, id long, distance double"
    rows = base.filter(F.col(vector).isNotNull()).select("id", vector)
    split = parts(queries, BLOCK * BLOCKS)
    outs = []
    for part in split:
        qids, vectors = collected(part)
        cut = np.full(len(qids), np.inf)
        if cuts is not None and len(qids):
            known = (cuts if len(split) == 1 else cuts.join(part.select("qid"), "qid", "left_semi")).select("qid", "distance").toArrow()  # one a query at most
            cut[np.searchsorted(qids, known["qid"].to_numpy())] = known["distance"].to_numpy()
        plans = []
        # where there are many blocks, a task scores a larger share of the base: what is shuffled does not grow with the base's partitions
        share = rows if len(qids) <= 4 * BLOCK else rows.coalesce(SHARES)
        for at in range(0, len(qids), BLOCK):
            sent = spark.sparkContext.broadcast((qids[at : at + BLOCK], vectors[at : at + BLOCK], cut[at : at + BLOCK]))  # at most BLOCK vectors

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                qid, q, cut = sent.value
                best, every, asked = Best(len(qid), k, radius, cut), np.arange(len(qid)), Asked(q, metric)
                step = max(64, min(2048, (1 << 19) // len(qid)))
                for batch in batches:
                    for at in range(0, batch.num_rows, step):
                        part = batch.slice(at, step)
                        x, square = (matrix(part.column(1)), None) if decode is None else decode(part.column(1))
                        if len(x) and x.shape[1] != q.shape[1]:
                            raise ValueError(f"queries have {q.shape[1]} dimensions, the base {x.shape[1]}")
                        if len(x):
                            best.add(part.column(0).to_numpy(zero_copy_only=False), x, asked, every, square)
                        if k is None:
                            j, ids, d = best.take()
                            yield pa.RecordBatch.from_arrays([qid[j], ids, d], schema=ARROW)
                if k is not None:
                    j, ids, d = best.take()
                    yield pa.RecordBatch.from_arrays([qid[j], ids, d], schema=ARROW)

            plans.append(share.mapInArrow(run, schema))
        if plans:
            found = reduce(DataFrame.union, plans)
            outs.append(checkpointed(found if k is None else ranked(found, k).drop("rank")) if len(split) > 1 else found)
    return reduce(DataFrame.union, outs) if outs else spark.createDataFrame([], schema)


def ranked(scores: DataFrame, k: int | None = None, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Adds rank among a query's rows by distance and id; at most k rows a query."""
    order = Window.partitionBy(*keys).orderBy("distance", "id")
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.filter(F.col("rank") <= k)


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", where: Column | None = None, threshold: float | None = None, vector: str = "vector") -> DataFrame:
    """(qid, rank, id, distance). where is applied before any distance; threshold after, before the cut at k."""
    if k <= 0:
        raise InvalidArgument("k must be positive")
    base = base if where is None else base.filter(where)
    found = candidates(base, queries, metric, k, threshold, vector) if threshold is None else candidates(base, queries, metric, k, vector=vector).filter(F.col("distance") <= threshold)
    return ranked(found, k).select("qid", "rank", "id", "distance")


def range_search(base: DataFrame, queries: DataFrame, radius: float, metric: str = "l2", limit: int = -1, where: Column | None = None, vector: str = "vector") -> DataFrame:
    """Rows with distance <= radius; limit < 0: all, > 0: the nearest so many, 0 is an error."""
    if radius < 0:
        raise InvalidArgument("radius must not be negative")
    if limit == 0:
        raise InvalidArgument("limit must not be 0")
    base = base if where is None else base.filter(where)
    if limit > 0:
        return ranked(candidates(base, queries, metric, limit, vector=vector).filter(F.col("distance") <= radius), limit).select("qid", "rank", "id", "distance")
    return ranked(candidates(base, queries, metric, None, radius, vector)).select("qid", "rank", "id", "distance")


def knn_by_expression(base: DataFrame, queries: DataFrame, k: int, score: Callable[[Column, Column], Column], vector: str = "vector", where: Column | None = None) -> DataFrame:
    """Top k by any column function of (vector, q), such as a user's own distance or a pandas UDF. Non-finite values raise. A function that
    names its metric (D.l2, D.ip, D.cosine) is searched by products; tasks return their best k of any other."""
    base = (base if where is None else base.filter(where)).filter(F.col(vector).isNotNull())
    if (metric := getattr(score, "metric", None)) is not None:
        wrong = F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
        fail = F.raise_error(F.lit(NOT_FINITE)).cast(base.schema[vector].dataType)
        rows = base.select("id", F.when(wrong, fail).otherwise(F.col(vector)).alias(vector))
        return ranked(candidates(rows, queries, metric, k, vector=vector), k).select("qid", "rank", "id", "distance")
    outs = []
    split = parts(queries.select("qid", "q"), BLOCK)
    for part in split:
        rows = base.select("id", vector).join(F.broadcast(part)).withColumn("distance", score(F.col(vector), F.col("q")))  # at most about BLOCK queries
        bad = F.isnan("distance") | (F.abs("distance") == float("inf"))
        rows = rows.withColumn("distance", F.when(bad, F.raise_error(F.lit(NOT_FINITE)).cast("double")).otherwise(F.col("distance").cast("double")))
        found = ranked(_narrowed(rows.select("qid", "id", "distance"), k), k).select("qid", "rank", "id", "distance")
        outs.append(checkpointed(found) if len(split) > 1 else found)
    return reduce(DataFrame.union, outs)


NOT_FINITE = "the distance function returned a value that is not finite"


def _narrowed(scores: DataFrame, k: int) -> DataFrame:
    """The task-wise best k of each query, without a sort or shuffle of all rows (qid, id, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            qid, ids, d = (batch.column(i).to_numpy() for i in range(3))
            if held is not None:
                qid, ids, d = (np.concatenate(c) for c in zip(held, (qid, ids, d), strict=True))
            if held is None or len(qid) > 2 * kept + 50_000:
                order = np.lexsort((ids, d, qid))
                qid, ids, d = qid[order], ids[order], d[order]
                best = np.arange(len(qid)) - np.searchsorted(qid, qid) < k
                qid, ids, d = qid[best], ids[best], d[best]
                kept = len(qid)
            held = qid, ids, d
        if held is not None:
            yield pa.RecordBatch.from_arrays(list(held), schema=ARROW)

    return scores.select(F.col("qid").cast("long"), F.col("id").cast("long"), "distance").filter("distance is not null").mapInArrow(run, "qid long, id long, distance double")


def page(scores: DataFrame, k: int, after: dict[int, tuple[float, int]] | None = None, number: int | None = None) -> DataFrame:
    """The next k rows of each query after a cursor (distance, id), or page number (from 1) of a candidates() frame."""
    if number is not None:
        lo = (number - 1) * k
        return ranked(scores, number * k).filter(F.col("rank") > lo).select("qid", "rank", "id", "distance")
    cond = F.lit(True)
    for qid, (d, i) in (after or {}).items():
        cond = cond & ((F.col("qid") != qid) | (F.col("distance") > d) | ((F.col("distance") == d) & (F.col("id") > i)))
    return ranked(scores.filter(cond), k).select("qid", "rank", "id", "distance")


def padded(result: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exactly k rows a query: missing ones have id -1 and infinite distance."""
    slots = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return slots.join(result, ["qid", "rank"], "left").select("qid", "rank", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def distance_by_ids(base: DataFrame, queries: DataFrame, wanted: DataFrame, metric: str = "l2", topk: int | None = None) -> DataFrame:
    """(qid, id, distance) for wanted (qid, id); -1 where the id is missing. With topk the nearest valid rows first, NaN last."""
    d = D.distance(metric)
    rows = wanted.join(queries.select("qid", "q"), "qid").join(base.select("id", "vector"), "id", "left")
    rows = rows.select("qid", "id", F.when(F.col("vector").isNull(), F.lit(-1.0)).otherwise(d(F.col("vector"), F.col("q"))).alias("distance"))
    if topk is None:
        return rows
    order = Window.partitionBy("qid").orderBy(F.col("distance") == -1.0, F.isnan("distance"), "distance", "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= topk)


def within(base: DataFrame, q: list[float], threshold: float) -> DataFrame:
    """ids of rows whose squared l2 distance to one vector is at most threshold."""
    return base.filter(D.l2(F.col("vector"), F.array(*map(F.lit, map(float, q)))) <= threshold).select("id")


def rerank(found: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", radius: float | None = None) -> DataFrame:
    """Scores candidates (qid, id) exactly and keeps the best k."""
    d = D.distance(metric)
    rows = found.select("qid", "id").distinct().join(base.select("id", "vector"), "id").join(queries.select("qid", "q"), "qid")
    rows = rows.select("qid", "id", d(F.col("vector"), F.col("q")).alias("distance"))
    rows = rows.filter(~F.isnan("distance")) if radius is None else rows.filter(F.col("distance") <= radius)
    return ranked(rows, k).select("qid", "rank", "id", "distance")
