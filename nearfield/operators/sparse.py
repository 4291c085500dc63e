"""Sparse search over postings (id, term, weight): 1 - inner product, joined on terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.search import ranked
from nearfield.sources.store import checkpointed

MOST_TERM = 1_000_000

#: Bytes of documents, as stored, whose terms a task counts.
DEALT = 16 << 20


def tokens(docs: DataFrame, key: str, text: str = "text", name: str = "id", only: DataFrame | None = None, window_size: int | None = None) -> DataFrame:
    """(name, term, weight): lower-case runs of a to z of two letters or more, and how often each occurs; only: just its terms,
    the others going before they are counted. Documents are dealt by id before they are split, so that terms are counted, and what
    goes by id finds them, where they are; window_size: with the window of so many ids, by which they are dealt then."""
    keys = [name] if window_size is None else ["window", name]
    rows = docs.select(F.col(key).alias(name), F.col(text).alias("_text"))
    rows = rows if window_size is None else rows.withColumn("window", _window(name, window_size))
    if only is None:
        bytes_ = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(max(most, min(1 << 13, bytes_ // DEALT)), keys[0])
    words = F.filter(F.split(F.lower("_text"), "[^a-z]+"), lambda x: F.length(x) >= 2)
    each = rows.select(*keys, F.explode(words).alias("term"))
    if only is not None:
        each = each.join(only.select("term").distinct(), "term", "left_semi")
    return each.groupBy(*keys, "term").agg(F.count("*").cast("double").alias("weight"))


def _window(id_: str, size: int) -> Column:
    return F.floor(F.col(id_) / size).cast("long")


def from_arrays(rows: DataFrame) -> DataFrame:
    """Postings of (id, ids array, vals array); ids above MOST_TERM raise, empty vectors give none."""
    out = rows.select("id", F.inline(F.arrays_zip(F.col("ids").alias("term"), F.col("vals").alias("weight"))))
    return out.withColumn("term", F.when(F.col("term") <= MOST_TERM, F.col("term")).otherwise(F.raise_error(F.lit("a term id is above the limit")).cast("long")))


def remap(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings with dense term ids, dictionary). Numbers come by partition, so no global order is needed."""
    words = postings.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id())
    return postings.join(words, "term").select("id", F.col("term_id").alias("term"), "weight"), words


def posting_rank(postings: DataFrame, window_size: int = 50_000) -> DataFrame:
    """Adds window (unless tokens() has) and rank, the place in a term's list of its window: heaviest first, then by id."""
    out = postings if "window" in postings.columns else postings.withColumn("window", _window("id", window_size))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("window", "term").orderBy(F.desc("weight"), "id")))


def prune_documents(postings: DataFrame, ratio: float) -> DataFrame:
    """The shortest run of a document's heaviest terms that holds 1 - ratio of its mass; single terms stay."""
    order = Window.partitionBy("id").orderBy(F.desc("weight"), "term")
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    every = Window.partitionBy("id")
    rows = postings.withColumns({"_before": before, "_mass": F.sum("weight").over(every)})
    return rows.filter(F.col("_before") < F.lit(1.0 - ratio) * F.col("_mass")).drop("_before", "_mass")


def prune_queries(queries: DataFrame, ratio: float) -> DataFrame:
    """A query's floor((1 - ratio) n) heaviest terms, at least one; ties by term."""
    order = Window.partitionBy("qid").orderBy(F.desc("weight"), "term")
    rows = queries.withColumns({"_rank": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy("qid"))})
    return rows.filter(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.lit(1.0 - ratio) * F.col("_n")))).drop("_rank", "_n")


def prune_terms(postings: DataFrame, ratio: float) -> DataFrame:
    """The first max(1, floor(ratio n)) entries of each term's list."""
    order = Window.partitionBy("term").orderBy(F.desc("weight"), "id")
    rows = postings.withColumns({"_rank": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy("term"))})
    return rows.filter(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.lit(ratio) * F.col("_n")))).drop("_rank", "_n")


def quantize_values(postings: DataFrame) -> DataFrame:
    """Weights rounded down to 8-bit codes over the table's range, and decoded."""
    span = postings.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    code = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("weight") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255)).otherwise(255)
    return postings.join(F.broadcast(span)).withColumn("code", code.cast("int")).withColumn("weight", F.col("lo") + F.col("code") / 255 * (F.col("hi") - F.col("lo"))).drop("lo", "hi")


def inner_products(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, distance) for pairs that share a term with a positive inner product."""
    q = queries.select("qid", "term", F.col("weight").alias("_qw"))
    sums = postings.join(q, "term").groupBy("qid", "id").agg(F.sum(F.col("_qw") * F.col("weight")).alias("ip"))
    return sums.filter("ip > 0").select("qid", "id", (F.lit(1.0) - F.col("ip")).alias("distance"))


def knn(postings: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    postings = postings if where is None else postings.filter(where)
    return ranked(inner_products(postings, queries), k).select("qid", "rank", "id", "distance")


def range_search(postings: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    return ranked(inner_products(postings, queries).filter(F.col("distance") <= radius)).select("qid", "rank", "id", "distance")


def rerank(coarse: DataFrame, postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact inner products, with the unpruned query, of coarse candidates."""
    kept = checkpointed(coarse.select("qid", "id").distinct())
    postings = postings.join(kept.select("id").distinct(), "id", "left_semi")  # which goes before documents are split
    q = queries.select("qid", "term", F.col("weight").alias("_qw"))
    rows = kept.join(postings, "id").join(q, ["qid", "term"]).groupBy("qid", "id").agg(F.sum(F.col("_qw") * F.col("weight")).alias("ip"))
    return ranked(rows.filter("ip > 0").select("qid", "id", (F.lit(1.0) - F.col("ip")).alias("distance")), k).select("qid", "rank", "id", "distance")


def posting_stats(postings: DataFrame) -> DataFrame:
    """One row: how long the terms' lists are."""
    lists = postings.groupBy("term").agg(F.count("*").alias("n"))
    return lists.agg(F.count("*").alias("terms"), F.sum("n").alias("postings"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.avg("n").alias("mean"))
