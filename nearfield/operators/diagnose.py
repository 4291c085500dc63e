"""Recall, reasons for missed results, index statistics, measurements and parameter search."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import InvalidArgument


def recall(result: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, recall): the share of true ids that the result has."""
    hit = truth.select("qid", "id").join(result.select("qid", "id").withColumn("_hit", F.lit(1)), ["qid", "id"], "left")
    return hit.groupBy("qid").agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count("*")).alias("recall"))


def nearest_found(result: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, recall): 1 if the single nearest id is in the result."""
    return recall(result, truth.filter("rank = 1"))


def size_ratio(result: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, ratio): sizes only, without a look at ids."""
    n = truth.groupBy("qid").agg(F.count("*").alias("_t"))
    m = result.groupBy("qid").agg(F.count("*").alias("_r"))
    return n.join(m, "qid", "left").select("qid", (F.coalesce("_r", F.lit(0)) / F.col("_t")).alias("ratio"))


def reasons(expected: DataFrame, reached: DataFrame, passing: DataFrame, coarse: DataFrame, reranked: DataFrame, result: DataFrame, error_ratio: float = 1.5) -> DataFrame:
    """(qid, id, reason) for expected (qid, id); the first that applies:
    not_reachable, filter_rejected, quantization_error, ef_too_small, reorder_evicted, unknown, success is checked before all.

    reached and coarse have (qid, id); coarse also distance and exact; passing has id.
    """

    def flag(df: DataFrame, name: str, on: list[str]) -> DataFrame:
        return df.select(*on).distinct().withColumn(name, F.lit(True))

    rows = expected.select("qid", "id").join(flag(result, "_result", ["qid", "id"]), ["qid", "id"], "left").join(flag(reached, "_reached", ["qid", "id"]), ["qid", "id"], "left")
    rows = rows.join(flag(passing, "_passing", ["id"]), "id", "left").join(flag(reranked, "_reranked", ["qid", "id"]), ["qid", "id"], "left")
    rows = rows.join(coarse.select("qid", "id", F.col("distance").alias("_d"), F.col("exact").alias("_e")), ["qid", "id"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(yes("_result"), "success").when(~yes("_reached"), "not_reachable").when(~yes("_passing"), "filter_rejected")
        .when(F.col("_d") > F.lit(error_ratio) * F.col("_e"), "quantization_error").when(F.col("_d").isNull(), "ef_too_small")
        .when(yes("_reranked"), "reorder_evicted").otherwise("unknown")
    )
    return rows.select("qid", "id", reason.alias("reason"))


def min_max_id(base: DataFrame) -> DataFrame:
    return base.agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"))


def vectors_by_ids(base: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """(position, id, columns) in the order of wanted (position, id); a missing id raises when read."""
    rows = wanted.join(base.select("id", F.lit(True).alias("_there"), *columns), "id", "left")
    checked = F.when(F.col("_there"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no row with id "), F.col("id"))).cast("long"))
    return rows.select("position", checked.alias("id"), *columns)


def measure(run: Callable[[], DataFrame], queries: int, times: int = 3) -> dict[str, float]:
    """Queries a second and latency over some runs of a batch."""
    spent = []
    for _ in range(times):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        spent.append(time.perf_counter() - began)
    spent.sort()
    return {"qps": queries * times / sum(spent), "latency_avg": sum(spent) / times / queries, "latency_p50": spent[len(spent) // 2] / queries, "latency_max": spent[-1] / queries}


def tune(spark: SparkSession, grid: dict[str, list], run: Callable[[dict], DataFrame], truth: DataFrame, least_recall: float) -> DataFrame:
    """(params, recall, seconds, chosen): every combination, the fastest that reaches the recall chosen."""
    rows = []
    for values in itertools.product(*grid.values()):
        params = dict(zip(grid, values, strict=True))
        began = time.perf_counter()
        got = recall(run(params), truth).agg(F.avg("recall")).first()[0] or 0.0
        rows.append((str(params), float(got), time.perf_counter() - began))
    good = [r for r in rows if r[1] >= least_recall]
    best = min(good, key=lambda r: r[2])[0] if good else None
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], "params string, recall double, seconds double, chosen boolean")


def detail(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(component, rows, columns): what an index is made of."""
    return spark.createDataFrame([(name, df.count(), ",".join(df.columns)) for name, df in sorted(tables.items())], "component string, rows long, columns string")


def analyze(search: Callable[[], DataFrame], truth: DataFrame) -> dict[str, float]:
    """Recall of a search, its mean distance, the mean bias against the true distances of the same ranks, and seconds."""
    began = time.perf_counter()
    got = search().cache()
    rows = got.count()
    spent = time.perf_counter() - began
    both = got.join(truth.select("qid", "rank", F.col("distance").alias("_t")), ["qid", "rank"])
    mean = got.agg(F.avg("distance")).first()[0] or 0.0
    bias = both.agg(F.avg(F.col("distance") - F.col("_t"))).first()[0] or 0.0
    out = {"recall": recall(got, truth).agg(F.avg("recall")).first()[0] or 0.0, "distance": mean, "bias": bias, "rows": rows, "seconds": spent}
    got.unpersist()
    return out


def edge_quality(edges: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of true nearest neighbours among the edges, and the mean distance of edges and of true ones."""
    hit = exact.select("src", "dst").join(edges.select("src", "dst").withColumn("_hit", F.lit(1)), ["src", "dst"], "left")
    share = hit.agg(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("recall"))
    return share.join(F.broadcast(edges.agg(F.avg("distance").alias("mean_distance")))).join(F.broadcast(exact.agg(F.avg("distance").alias("exact_distance"))))


def export(measures: dict[str, float], form: str = "table", name: str = "search", tags: dict[str, str] | None = None) -> str:
    """Measures as a table, JSON, or a line of name, tags and fields."""
    if form == "json":
        return json.dumps({"name": name, **(tags or {}), **measures}, sort_keys=True)
    if form == "line":
        return ",".join([name, *(f"{k}={v}" for k, v in sorted((tags or {}).items()))]) + " " + ",".join(f"{k}={v}" for k, v in sorted(measures.items()))
    if form != "table":
        raise InvalidArgument("form must be table, json or line")
    width = max(map(len, measures), default=0)
    return "\n".join(f"{k:<{width}}  {v:.6g}" for k, v in sorted(measures.items()))
