"""One query for each operator over the driver's tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield import index as index_module
from nearfield.functions import distance as D
from nearfield.functions import quantize as Q
from nearfield.operators import diagnose, graph, hierarchy, ivf, multivector, mutate, search, sparse
from nearfield.plans import filters, planner
from nearfield.plans.request import SearchRequest
from nearfield.sources import store
from nearfield.streaming.ingest import Ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# tables


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with attributes: tags (two values, or none), a text field, and two path hierarchies."""
    e = read(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    return e.select(
        i.alias("id"), F.col("embedding").alias("vector"), "label", F.when(i % 11 != 0, F.array("label", (i % 7).cast("int"))).alias("tags"),
        F.concat(F.lit("c"), F.col("label")).alias("cat"), F.concat(F.lit("g"), F.col("label") % 2, F.lit("/l"), F.col("label")).alias("path"),
        F.concat(F.lit("m"), i % 3, F.lit("/n"), i % 6).alias("path_b"), F.encode(F.concat(F.col("label"), F.lit("-"), i), "utf-8").alias("extra"),
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return base(spark, sf_dir), asked(spark, sf_dir)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    out = df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns or ("distance",)})
    return out.withColumn("rank", F.col("rank").cast("long")) if "rank" in out.columns else out


# SQL


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def l2_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def distance_sql(metric: str, a: str, b: str) -> str:
    if metric == "l2":
        return l2_sql(a, b)
    if metric == "ip":
        return f"1.0 - {dot_sql(a, b)}"
    return f"1.0 - {dot_sql(a, b)} / (sqrt({dot_sql(a, a)}) * sqrt({dot_sql(b, b)}))"


BASE = """base AS (SELECT vec_id AS id, embedding AS vector, label, CASE WHEN vec_id % 11 <> 0 THEN [label, (vec_id % 7)::INTEGER] END AS tags,
 'c' || label AS cat, 'g' || (label % 2) || '/l' || label AS path, 'm' || (vec_id % 3) || '/n' || (vec_id % 6) AS path_b, label || '-' || vec_id AS extra FROM embeddings),
q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 100 = 0)"""


def scores_sql(metric: str = "l2", rows: str = "base", where: str = "TRUE", vector: str = "vector") -> str:
    return f"s AS (SELECT qid, id, {distance_sql(metric, vector, 'q')} AS d FROM (SELECT * FROM {rows} WHERE {where}), q)"


def top_sql(k: int | None, where: str = "TRUE", frame: str = "s", digits: int = 6, low: int = 0) -> str:
    cut = f"rank > {low}" + (f" AND rank <= {k}" if k else "")
    return f"SELECT qid, rank, id, round(d, {digits}) + 0.0 AS distance FROM (SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM {frame} WHERE {where}) WHERE {cut}"


def knn_sql(k: int | None = 10, metric: str = "l2", rows: str = "base", where: str = "TRUE", cut: str = "TRUE", more: str = "", low: int = 0, digits: int = 6, vector: str = "vector") -> str:
    return f"WITH {BASE}{more}, {scores_sql(metric, rows, where, vector)} {top_sql(k, cut, digits=digits, low=low)}"


# exact search


@query(knn_sql())
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.knn(*both(spark, sf_dir), 10, "l2"))


@query(knn_sql(metric="ip"))
def knn_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.knn(*both(spark, sf_dir), 10, "ip"))


@query(knn_sql(metric="cosine"))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.knn(*both(spark, sf_dir), 10, "cosine"))


@query(knn_sql(metric="cosine"))
def knn_custom_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.knn_by_expression(*both(spark, sf_dir), 10, D.cosine))


@query(knn_sql(None, cut="d <= 1.6"))
def range_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.range_search(*both(spark, sf_dir), 1.6))


@query(knn_sql(7, cut="d <= 1.9"))
def range_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.range_search(*both(spark, sf_dir), 1.9, limit=7))


@query(knn_sql(10, cut="d <= 1.5"))
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.knn(*both(spark, sf_dir), 10, threshold=1.5))


@query(knn_sql(20, low=10))
def knn_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    return rounded(search.page(search.candidates(b, q, "l2", 20), 10, number=2))


@query(f"WITH {BASE}, {scores_sql()}, r AS ({top_sql(10, 'd <= 1.5')}), n AS (SELECT qid, unnest(range(1, 11)) AS rank FROM q) SELECT n.qid, n.rank, coalesce(r.id, -1) AS id, coalesce(r.distance, -1.0) AS distance FROM n LEFT JOIN r USING (qid, rank)")
def knn_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    out = rounded(search.padded(search.knn(b, q, 10, threshold=1.5), q, 10))
    return out.withColumn("distance", F.when(F.col("distance") == float("inf"), -1.0).otherwise(F.col("distance")))


@query(f"WITH {BASE} SELECT id FROM base WHERE {l2_sql('vector', '(SELECT q FROM q WHERE qid = 0)')} <= 1.7")
def l2_and_filtering(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    return search.within(b, q.filter("qid = 0").first().q, 1.7)


# by id

_WANTED = "w AS (SELECT qid, (qid * 7 + n * 31) % 700 AS id FROM q, (SELECT unnest(range(0, 20)) AS n))"


def wanted(q: DataFrame) -> DataFrame:
    return q.select("qid", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("n")).select("qid", ((F.col("qid") * 7 + F.col("n") * 31) % 700).alias("id"))


@query(f"WITH {BASE}, {_WANTED} SELECT w.qid, w.id, CASE WHEN b.id IS NULL THEN -1.0 ELSE round({l2_sql('b.vector', 'q.q')}, 6) + 0.0 END AS distance FROM w JOIN q USING (qid) LEFT JOIN base b ON b.id = w.id")
def distance_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    return rounded(search.distance_by_ids(b, q, wanted(q)))


@query(f"WITH {BASE}, {_WANTED}, s AS (SELECT w.qid, w.id, CASE WHEN b.id IS NULL THEN -1.0 ELSE {l2_sql('b.vector', 'q.q')} END AS d FROM w JOIN q USING (qid) LEFT JOIN base b ON b.id = w.id) SELECT qid, id, rank, round(d, 6) + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d = -1.0, d, id) AS rank FROM s) WHERE rank <= 5")
def distance_by_ids_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    return rounded(search.distance_by_ids(b, q, wanted(q), topk=5)).select("qid", "id", "rank", "distance")


@query(f"WITH {BASE}, w AS (SELECT n AS position, (n * 37) % 400 AS id FROM (SELECT unnest(range(0, 12)) AS n)) SELECT w.position, w.id, b.label, round({dot_sql('b.vector', 'b.vector')}, 5) + 0.0 AS square FROM w JOIN base b USING (id)")
def vectors_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spark.range(12).select(F.col("id").alias("position"), (F.col("id") * 37 % 400).alias("id"))
    out = diagnose.vectors_by_ids(base(spark, sf_dir), w, ["label", "vector"])
    return rounded(out.select("position", "id", "label", D.dot(F.col("vector"), F.col("vector")).alias("square")), "square", digits=5)


@query(f"WITH {BASE} SELECT min(id) AS min_id, max(id) AS max_id FROM base")
def min_max_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.min_max_id(base(spark, sf_dir))


@query(f"WITH {BASE} SELECT id FROM base")
def export_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id")


@query(f"WITH {BASE}, {_WANTED} SELECT DISTINCT w.id, b.id IS NOT NULL AS found FROM w LEFT JOIN base b ON b.id = w.id")
def id_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    i = index_module.create("flat", '{"dim": 64}')
    i.tables["rows"] = b
    return i.exists(wanted(q).select("id").distinct())


@query(f"WITH {BASE} SELECT count(*) FILTER (id % 10 <> 3) AS alive, count(*) FILTER (id % 10 = 3) AS removed FROM base")
def count_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    live = mutate.alive(b, b.filter("id % 10 = 3")).agg(F.count("*").alias("alive"))
    return live.join(F.broadcast(b.filter("id % 10 = 3").agg(F.count("*").alias("removed"))))


# filters


def filtered(name: str, text: str, sql_where: str, k: int = 10) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b, q = both(spark, sf_dir)
        return rounded(search.knn(b, q, k, where=filters.parse(text, b.schema)))

    run.__name__ = name
    run.__doc__ = f"kNN where {text}"
    query(knn_sql(k, where=sql_where))(run)


_TAG = "coalesce(list_contains(tags, {}), FALSE)"
filtered("knn_attr_eq", "label = 3", "label = 3")
filtered("knn_attr_ne", "tags != 2", f"NOT {_TAG.format(2)}")
filtered("knn_attr_in", "tags IN [1, 4, 6]", " OR ".join(_TAG.format(x) for x in (1, 4, 6)))
filtered("knn_attr_not_in", "tags NOT_IN [1, 4]", f"NOT ({_TAG.format(1)} OR {_TAG.format(4)})")
filtered("knn_attr_string", 'cat IN ["c1", "c7"]', "cat IN ('c1', 'c7')")
filtered("knn_attr_string_number", 'cat = "c2" OR cat = 5 # a number against text', "cat = 'c2' OR cat = '5'")
filtered("knn_attr_and_or", "label = 1 OR label = 2 AND tags = 3", f"(label = 1 OR label = 2) AND {_TAG.format(3)}")
filtered("knn_attr_pipe", 'multi_in(tags, "2|5", "|") && cat NOTIN ["c3"]', f"({_TAG.format(2)} OR {_TAG.format(5)}) AND cat NOT IN ('c3')")
filtered("attr_range_ext", "label >= 3 AND label < 6 AND !(tags = 4)", f"label >= 3 AND label < 6 AND NOT {_TAG.format(4)}")
filtered("attr_arithmetic_ext", "label * 2 + 1 > 9", "label * 2 + 1 > 9")


@query(knn_sql(where="id NOT IN (SELECT id FROM base WHERE id % 4 = 1)"))
def knn_bitset(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    return rounded(search.knn(mutate.alive(b, b.filter("id % 4 = 1")), q, 10))


@query(knn_sql(where="id % 3 = 0"))
def knn_id_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.knn(*both(spark, sf_dir), 10, where=F.col("id") % 3 == 0))


@query(knn_sql(where="extra LIKE '4%'"))
def knn_extra_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.knn(*both(spark, sf_dir), 10, where=F.substring("extra", 1, 1) == F.encode(F.lit("4"), "utf-8")))


@query(knn_sql(where="label IN (1, 2, 3) AND id % 2 = 0 AND NOT (id % 5 = 0) AND id % 10 <> 8"))
def knn_all_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    i = index_module.create("brute_force", '{"dim": 64}')
    i.build(b)
    return rounded(i.search(SearchRequest(q, where="label IN [1,2,3]", keep=F.col("id") % 2 == 0, exclude=F.col("id") % 5 == 0, exclude_ids=b.filter("id % 10 = 8"))))


@query(f"WITH {BASE} SELECT round(count(*) FILTER (label = 3) / count(*), 6) + 0.0 AS valid_ratio FROM base")
def valid_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    cond = filters.parse("label = 3", b.schema)
    return rounded(b.agg((F.sum(cond.cast("long")) / F.count("*")).alias("valid_ratio")), "valid_ratio")


# changes


@query(f"WITH {BASE}, n AS (SELECT id, label FROM base WHERE id < 20 UNION ALL SELECT id + 1000000, label FROM base WHERE id < 30) SELECT id, label FROM base UNION ALL SELECT id, label FROM n WHERE id NOT IN (SELECT id FROM base)")
def add_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    new = b.filter("id < 20").union(b.filter("id < 30").withColumn("id", F.col("id") + 1_000_000))
    return mutate.add(b, new)[0].select("id", "label")


@query(f"WITH {BASE} SELECT id FROM base WHERE id < 20 UNION SELECT id + 1000000 FROM base WHERE id < 10")
def add_failed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    more = b.filter("id < 10").withColumn("id", F.col("id") + 1_000_000)
    return mutate.add(b, b.filter("id < 20").union(more).union(more))[1]


@query(knn_sql(where="id % 10 <> 3"))
def knn_after_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    i = index_module.create("flat", '{"dim": 64}')
    i.build(b)
    i.remove(b.filter("id % 10 = 3"))
    return rounded(i.search(SearchRequest(q)))


@query(knn_sql(rows="u", more=", u AS (SELECT id, CASE WHEN id >= 100 AND id < 110 THEN (SELECT q FROM q WHERE qid = 100) ELSE vector END AS vector FROM base)"))
def update_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    new = q.filter("qid = 100").select(F.col("q").alias("vector"), F.explode(F.sequence(F.lit(100).cast("long"), F.lit(109).cast("long"))).alias("id"))
    return rounded(search.knn(mutate.update(b, new, ["vector"]), q, 10))


@query(knn_sql(rows="u", more=", u AS (SELECT CASE WHEN id = 100 THEN 777777 ELSE id END AS id, vector FROM base)"))
def update_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    return rounded(search.knn(mutate.update_id(b, 100, 777_777), q, 10))


@query(f"WITH {BASE} SELECT id, CASE WHEN id % 50 = 0 THEN 99 ELSE label END AS label, CASE WHEN id % 50 = 0 THEN 'new' ELSE cat END AS cat FROM base")
def update_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    changes = b.filter("id % 50 = 0").select("id", F.lit(99).alias("label"), F.lit("new").alias("cat"))
    return mutate.update(b, changes, ["label", "cat"]).select("id", "label", "cat")


@query(f"WITH {BASE} SELECT id, CASE WHEN id < 5 THEN 'x' || id ELSE extra END AS extra FROM base")
def update_extra_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    changes = b.filter("id < 5").select("id", F.encode(F.concat(F.lit("x"), F.col("id")), "utf-8").alias("extra"))
    return mutate.update(b, changes, ["extra"]).select("id", F.decode("extra", "utf-8").alias("extra"))


@query(knn_sql(rows="u", more=", u AS (SELECT id, vector FROM base UNION ALL SELECT id + 1000000, vector FROM base)"))
def merge_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    return rounded(search.knn(mutate.merge(b, b, F.col("id") + 1_000_000), q, 10))


@query("SELECT user_id AS id, arg_max(value, event_id) AS value FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def apply_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").filter("event_type in ('signup', 'purchase', 'error')")
    log = log.select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"), "value")
    return mutate.apply_log(log.select("id", "value").limit(0), log)


# sparse

_TOKENS = """t AS (SELECT doc_id AS id, term, count(*)::DOUBLE AS weight FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents) WHERE length(term) >= 2 GROUP BY ALL),
sq AS (SELECT item_id AS qid, term, count(*)::DOUBLE AS weight FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM benchmark WHERE item_id % 100 = 0) WHERE length(term) >= 2 GROUP BY ALL)"""


def terms(spark: SparkSession, sf_dir: str, asked_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Postings and queries; asked_only: postings of the queries' terms alone, for what needs no others."""
    q = store.checkpointed(sparse.tokens(read(spark, sf_dir, "benchmark").filter("item_id % 100 = 0"), "item_id", name="qid"))
    return sparse.tokens(read(spark, sf_dir, "documents"), "doc_id", only=q if asked_only else None), q


def sparse_sql(docs: str = "t", queries: str = "sq", more: str = "", cut: str = "TRUE", k: int | None = 10, digits: int = 6) -> str:
    return f"WITH {_TOKENS}{more}, s AS (SELECT * FROM (SELECT qid, id, 1.0 - sum(a.weight * b.weight) AS d FROM {docs} a JOIN {queries} b USING (term) GROUP BY qid, id) WHERE d < 1.0) {top_sql(k, cut, digits=digits)}"


_PRUNED = ", p AS (SELECT id, term, weight FROM (SELECT *, coalesce(sum(weight) OVER (PARTITION BY id ORDER BY weight DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (PARTITION BY id) AS mass FROM t) WHERE before < (1.0 - 0.4::DOUBLE) * mass)"
_QPRUNED = ", qp AS (SELECT qid, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, term) AS r, count(*) OVER (PARTITION BY qid) AS n FROM sq) WHERE r <= greatest(1, floor((1.0 - 0.5::DOUBLE) * n)))"


@query(sparse_sql())
def sparse_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sparse.knn(*terms(spark, sf_dir, asked_only=True), 10))


@query(sparse_sql(cut="d <= -60.0", k=None))
def sparse_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sparse.range_search(*terms(spark, sf_dir, asked_only=True), -60.0))


@query(sparse_sql(docs="p", more=_PRUNED))
def sparse_doc_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, q = terms(spark, sf_dir)
    return rounded(sparse.knn(sparse.prune_documents(t, 0.4), q, 10))


@query(sparse_sql(queries="qp", more=_QPRUNED))
def sparse_query_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, q = terms(spark, sf_dir, asked_only=True)
    return rounded(sparse.knn(t, sparse.prune_queries(q, 0.5), 10))


@query(sparse_sql(docs="tp", more=", tp AS (SELECT id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY weight DESC, id) AS r, count(*) OVER (PARTITION BY term) AS n FROM t) WHERE r <= greatest(1, floor(0.5::DOUBLE * n)))"))
def sparse_term_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, q = terms(spark, sf_dir, asked_only=True)
    return rounded(sparse.knn(sparse.prune_terms(t, 0.5), q, 10))


@query(
    f"WITH {_TOKENS}{_PRUNED}{_QPRUNED}, c AS (SELECT * FROM (SELECT qid, id, 1.0 - sum(a.weight * b.weight) AS d FROM p a JOIN qp b USING (term) GROUP BY qid, id) WHERE d < 1.0), "
    "k AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS r FROM c) WHERE r <= 30), "
    f"s AS (SELECT k.qid, k.id, 1.0 - sum(t.weight * sq.weight) AS d FROM k JOIN t ON t.id = k.id JOIN sq ON sq.qid = k.qid AND sq.term = t.term GROUP BY ALL) {top_sql(10)}"
)
def sparse_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, q = terms(spark, sf_dir)
    return rounded(sparse.rerank(sparse.knn(sparse.prune_documents(t, 0.4), sparse.prune_queries(q, 0.5), 30), t, q, 10))


@query(sparse_sql(docs="e", more=", e AS (SELECT id, term, lo + floor((weight - lo) / (hi - lo) * 255) / 255 * (hi - lo) AS weight FROM t, (SELECT min(weight) AS lo, max(weight) AS hi FROM t))", digits=4).replace("1.0 - sum(a.weight * b.weight) AS d", "round(1.0 - sum(a.weight * b.weight), 6) AS d"))
def sparse_sq8(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, q = terms(spark, sf_dir)
    scores = sparse.inner_products(sparse.quantize_values(t), q).withColumn("distance", F.round("distance", 6))  # sums in any order tie alike
    return rounded(search.ranked(scores, 10).select("qid", "rank", "id", "distance"), digits=4)


@query(sparse_sql(docs="(SELECT * FROM t WHERE id % 10 NOT IN (3, 7))"))
def sparse_add_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of postings to which documents are added, some twice, and from which some are removed, for good or by marks."""
    t, q = terms(spark, sf_dir, asked_only=True)
    t = store.checkpointed(t)
    i = index_module.create("sindi", '{"dtype": "sparse", "metric_type": "ip", "representation": "sparse"}')
    i.build(t.filter("id % 2 = 0"))
    i.add(t.filter("id % 3 = 0 or id % 2 = 1"))
    i.remove(t.filter("id % 10 = 3").select("id").distinct(), force=True)
    i.remove(t.filter("id % 10 = 7").select("id").distinct())
    return rounded(i.search(SearchRequest(q)))


@query(f"WITH {_TOKENS} SELECT \"window\", term, id, rank FROM (SELECT id // 100 AS \"window\", term, id, row_number() OVER (PARTITION BY id // 100, term ORDER BY weight DESC, id) AS rank FROM t)")
def sparse_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sparse.posting_rank(sparse.tokens(read(spark, sf_dir, "documents"), "doc_id", window_size=100))
    return rows.select("window", "term", "id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_TOKENS} SELECT count(*) AS terms, sum(n)::BIGINT AS postings, min(n) AS shortest, max(n) AS longest, round(avg(n), 6) + 0.0 AS mean FROM (SELECT count(*) AS n FROM t GROUP BY term)")
def posting_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sparse.posting_stats(terms(spark, sf_dir)[0]), "mean")


@query(f"WITH {_TOKENS} SELECT a.qid, a.term, count(b.id) AS hits FROM sq a LEFT JOIN t b USING (term) GROUP BY ALL")
def sparse_term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, q = terms(spark, sf_dir, asked_only=True)
    return q.join(t.select("term", "id"), "term", "left").groupBy("qid", "term").agg(F.count("id").alias("hits"))


@query(f"WITH {_TOKENS} SELECT count(DISTINCT term) AS terms, count(*) AS n FROM t")
def sparse_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped, words = sparse.remap(terms(spark, sf_dir)[0])
    return mapped.agg(F.countDistinct("term").alias("terms"), F.count("*").alias("n"))


# several vectors a document

_MULTI = f"""d AS (SELECT vec_id // 4 AS id, list(embedding ORDER BY vec_id) AS vectors FROM embeddings GROUP BY ALL),
m AS (SELECT a.id AS qid, b.id, list_sum(list_transform(a.vectors, lambda t: list_min(list_transform(b.vectors, lambda u: 1.0 - {dot_sql('t', 'u')})))) AS d FROM d a, d b WHERE a.id % 100 = 0)"""


def documents_of_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tokens = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("id"), F.col("vec_id").alias("at"), F.col("embedding").alias("vector"))
    docs = multivector.gather(tokens)
    return docs, docs.filter("id % 100 = 0").select(F.col("id").alias("qid"), "vectors")


@query(f"WITH {_MULTI} {top_sql(10, frame='m')}")
def maxsim_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(multivector.knn(*documents_of_vectors(spark, sf_dir), 10))


@query(f"WITH {_MULTI} {top_sql(None, 'd <= 2.8', frame='m')}")
def maxsim_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(multivector.range_search(*documents_of_vectors(spark, sf_dir), 2.8))


_CENTROIDS = ", c AS (SELECT bucket_id, list(x ORDER BY pos) AS centroid FROM (SELECT label::BIGINT AS bucket_id, pos, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS pos, unnest(vector)::DOUBLE AS x FROM base) GROUP BY ALL) GROUP BY bucket_id)"


@query(
    f"WITH {BASE}{_CENTROIDS}, {_MULTI.replace('m AS', 'exact AS')}, tok AS (SELECT vec_id // 4 AS id, vec_id, embedding AS v FROM embeddings), "
    f"mem AS (SELECT DISTINCT id, bucket_id FROM (SELECT id, vec_id, bucket_id, row_number() OVER (PARTITION BY vec_id ORDER BY 1.0 - {dot_sql('v', 'centroid')}, bucket_id) AS r FROM tok, c) WHERE r = 1), "
    f"near AS (SELECT qid, vec_id, bucket_id, dd FROM (SELECT id AS qid, vec_id, bucket_id, dd, row_number() OVER (PARTITION BY vec_id ORDER BY dd, bucket_id) AS r FROM (SELECT id, vec_id, bucket_id, 1.0 - {dot_sql('v', 'centroid')} AS dd FROM tok, c WHERE id % 100 = 0)) WHERE r <= 3), "
    "best AS (SELECT qid, vec_id, mem.id, max(1.0 - dd) AS score FROM near JOIN mem USING (bucket_id) GROUP BY ALL), sums AS (SELECT qid, id, round(sum(score), 9) AS score FROM best GROUP BY ALL), "
    "keep AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM sums) WHERE r <= 40), "
    f"s AS (SELECT qid, id, d FROM exact JOIN keep USING (qid, id)) {top_sql(10)}"
)
def maxsim_coarse_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, q = documents_of_vectors(spark, sf_dir)
    c = centroids(spark, sf_dir)
    tokens = docs.select("id", F.posexplode("vectors").alias("at", "vector"))
    members = multivector.cluster(tokens, c)
    found = multivector.coarse(members, q.select("qid", F.posexplode("vectors").alias("at", "vector")), c, 3, 40, digits=9)
    return rounded(multivector.rerank(found, docs, q, 10))


# inverted buckets


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model without random starts: the mean vector of each label."""
    return ivf.mean_by(base(spark, sf_dir).withColumn("label", F.col("label").cast("long")), "label")


def _near_sql(n: int, rows: str = "base", key: str = "id", vector: str = "vector", name: str = "a", metric: str = "l2") -> str:
    return f", {name} AS (SELECT {key}, bucket_id, cd, r FROM (SELECT {key}, bucket_id, cd, row_number() OVER (PARTITION BY {key} ORDER BY cd, bucket_id) AS r FROM (SELECT {key}, bucket_id, {distance_sql(metric, vector, 'centroid')} AS cd FROM {rows}, c)) WHERE r <= {n})"


_ROUTE = _near_sql(3, "q", "qid", "q", "r3")


@query(f"WITH {BASE}{_CENTROIDS}{_near_sql(1)} SELECT id, bucket_id FROM a")
def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.assign(base(spark, sf_dir), centroids(spark, sf_dir))


@query(f"WITH {BASE}{_CENTROIDS}{_ROUTE} SELECT qid, r AS rank, bucket_id, round(cd, 6) + 0.0 AS distance FROM r3")
def ivf_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ivf.route(asked(spark, sf_dir), centroids(spark, sf_dir), 3)
    return rounded(out.select("qid", F.col("order").alias("rank"), "bucket_id", "distance"))


@query(f"WITH {BASE}{_CENTROIDS}{_near_sql(1)}{_ROUTE}, s AS (SELECT q.qid, base.id, {l2_sql('vector', 'q.q')} AS d FROM q JOIN r3 USING (qid) JOIN a ON a.bucket_id = r3.bucket_id JOIN base ON base.id = a.id) {top_sql(10)}")
def ivf_probe_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    c = centroids(spark, sf_dir)
    return rounded(ivf.probe_lists(ivf.listed(b, c), ivf.route(q, c, 3), q, 10))


@query(f"WITH {BASE}{_CENTROIDS}{_near_sql(2)}{_ROUTE}, s AS (SELECT DISTINCT q.qid, base.id, {l2_sql('vector', 'q.q')} AS d FROM q JOIN r3 USING (qid) JOIN a ON a.bucket_id = r3.bucket_id JOIN base ON base.id = a.id) {top_sql(10)}")
def ivf_multi_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    c = centroids(spark, sf_dir)
    return rounded(ivf.probe_lists(ivf.listed(b, c, 2), ivf.route(q, c, 3), q, 10))


@query(f"WITH {BASE}{_CENTROIDS}{_near_sql(1)}, s AS (SELECT q.qid, base.id, {l2_sql('vector', 'q.q')} AS d FROM q, a JOIN base ON base.id = a.id WHERE a.bucket_id IN (1, 4)) {top_sql(10)}")
def ivf_bucket_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    c = centroids(spark, sf_dir)
    return rounded(ivf.probe_lists(ivf.listed(b, c), ivf.chosen(q, [1, 4], c.count()), q, 10))


@query(f"WITH {BASE}{_CENTROIDS}{_near_sql(1)}{_ROUTE}, s AS (SELECT q.qid, base.id, {l2_sql('vector', 'q.q')} AS d FROM q JOIN r3 USING (qid) JOIN a ON a.bucket_id = r3.bucket_id JOIN base ON base.id = a.id) {top_sql(None, 'd <= 1.7')}")
def ivf_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    c = centroids(spark, sf_dir)
    return rounded(ivf.probe_lists(ivf.listed(b, c), ivf.route(q, c, 3), q, None, radius=1.7))


@query(f"WITH {BASE}{_CENTROIDS}{_near_sql(1)} SELECT id, bucket_id, round(cd, 6) + 0.0 AS square FROM a")
def ivf_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = base(spark, sf_dir), centroids(spark, sf_dir)
    rest = ivf.residuals(b, ivf.assign(b, c), c)
    return rounded(rest.select("id", "bucket_id", D.dot(F.col("vector"), F.col("vector")).alias("square")), "square")


_RESIDUAL = ", z AS (SELECT a.id, a.bucket_id, centroid, list_transform(list_zip(vector, centroid), lambda z: z[1]::DOUBLE - z[2]) AS rest FROM a JOIN base USING (id) JOIN c USING (bucket_id)), zr AS (SELECT list(lo ORDER BY pos) AS low, list(hi - lo ORDER BY pos) AS width FROM (SELECT pos, min(x) AS lo, max(x) AS hi FROM (SELECT unnest(range(1, 65)) AS pos, unnest(rest) AS x FROM z) GROUP BY pos)), u AS (SELECT id, bucket_id, list_transform(list_zip(rest, low, width, centroid), lambda z: floor(least(1.0, greatest(0.0, (z[1] - z[2]) / z[3])) * 255) / 255 * z[3] + z[2] + z[4]) AS vector FROM z, zr)"


@query(f"WITH {BASE}{_CENTROIDS}{_near_sql(1)}{_ROUTE}{_RESIDUAL}, s AS (SELECT q.qid, u.id, {l2_sql('vector', 'q.q')} AS d FROM q JOIN r3 USING (qid) JOIN u ON u.bucket_id = r3.bucket_id) {top_sql(10, digits=5)}")
def ivf_residual_sq8_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of 8-bit codes of residuals, searched as codes."""
    b, q = both(spark, sf_dir)
    c = store.checkpointed(centroids(spark, sf_dir))
    codes, decode = ivf.residual_codes(ivf.listed(b, c), c, lambda v: Q.fit_scalar(v, 8))
    return rounded(ivf.probe_lists(codes, ivf.route(q, c, 3), q, 10, vector="code", decode=decode), digits=5)


@query(f"WITH {BASE}{_CENTROIDS}{_near_sql(1)}{_ROUTE}, s AS (SELECT q.qid, base.id, {l2_sql('vector', 'q.q')} AS d FROM q JOIN r3 USING (qid) JOIN a ON a.bucket_id = r3.bucket_id JOIN base ON base.id = a.id) {top_sql(10)}")
def ivf_graph_probe_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed buckets, each walked by its own graph."""
    b, q = both(spark, sf_dir)
    c = store.checkpointed(centroids(spark, sf_dir))
    lists = store.checkpointed(ivf.listed(b, c))
    edges = ivf.bucket_edges(b, lists.select("id", "bucket_id"), 16)
    return rounded(ivf.graph_probe(lists, edges, ivf.route(q, c, 3), q, 10, beam=100))


@query(knn_sql())
def ivf_index_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with all its buckets probed is exact."""
    b, q = both(spark, sf_dir)
    i = index_module.create("ivf", '{"dim": 64, "index_param": {"buckets": 8, "rounds": 4}}')
    i.build(b)
    return rounded(i.search(SearchRequest(q, params={"scan_buckets_count": 8})))


@query(f"WITH {BASE}{_CENTROIDS}{_near_sql(1)} SELECT bucket_id, count(*) AS n_rows FROM a GROUP BY bucket_id")
def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.bucket_stats(ivf.assign(base(spark, sf_dir), centroids(spark, sf_dir)))


_TWO = _CENTROIDS.replace(", c AS", ", c1 AS") + f", c AS (SELECT s.bucket_id * 10 + t.bucket_id AS bucket_id, list_transform(list_zip(s.centroid, t.centroid), lambda z: z[1] + z[2]) AS centroid FROM c1 s, c1 t)"


@query(f"WITH {BASE}{_TWO}{_near_sql(1)} SELECT id, bucket_id FROM a")
def two_level_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = base(spark, sf_dir), centroids(spark, sf_dir)
    return ivf.assign(b, ivf.two_level(c, c))


@query(
    f"WITH {BASE}{_TWO}, f AS (SELECT qid, s FROM (SELECT qid, bucket_id AS s, row_number() OVER (PARTITION BY qid ORDER BY {l2_sql('centroid', 'q')}, bucket_id) AS r FROM q, c1) WHERE r <= 5), "
    f"p AS (SELECT qid, bucket_id, d, row_number() OVER (PARTITION BY qid ORDER BY d, bucket_id) AS r FROM (SELECT q.qid, c.bucket_id, {l2_sql('c.centroid', 'q.q')} AS d FROM q JOIN f USING (qid) JOIN c ON c.bucket_id // 10 = f.s)) "
    "SELECT qid, r AS rank, bucket_id, round(d, 6) + 0.0 AS distance FROM p WHERE r <= 6"
)
def two_level_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = centroids(spark, sf_dir)
    out = ivf.two_level_route(asked(spark, sf_dir), c, c, 6, 0.5)
    return rounded(out.select("qid", F.col("order").alias("rank"), "bucket_id", "distance"))


@query(f"WITH {BASE}{_CENTROIDS}{_near_sql(1)}, m AS (SELECT a.bucket_id, base.id, vector FROM a JOIN base USING (id)) SELECT bucket_id, src, dst, round(d, 6) + 0.0 AS distance FROM (SELECT x.bucket_id, x.id AS src, y.id AS dst, {l2_sql('x.vector', 'y.vector')} AS d, row_number() OVER (PARTITION BY x.id ORDER BY {l2_sql('x.vector', 'y.vector')}, y.id) AS r FROM m x JOIN m y ON x.bucket_id = y.bucket_id AND x.id <> y.id) WHERE r <= 4")
def ivf_bucket_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = base(spark, sf_dir), centroids(spark, sf_dir)
    return rounded(ivf.bucket_edges(b, ivf.assign(b, c), 4))


@query(f"WITH {BASE}{_CENTROIDS}{_near_sql(1)}{_ROUTE} SELECT r3.qid, count(DISTINCT r3.bucket_id) AS buckets, count(a.id) AS rows FROM r3 LEFT JOIN a USING (bucket_id) GROUP BY r3.qid")
def search_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    c = centroids(spark, sf_dir)
    return ivf.probe_stats(ivf.assign(b, c), ivf.route(q, c, 3))


@query(f"WITH {BASE} SELECT count(*) AS rows, count(*) * (8 + 4 * 64) AS bytes FROM base")
def memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index_module.create("flat", '{"dim": 64}')
    return base(spark, sf_dir).agg(F.count("*").alias("rows")).withColumn("bytes", F.col("rows") * i.estimate_memory(1))


@query(f"WITH {BASE}, st AS (SELECT label::BIGINT AS bucket_id, arg_min(vector, id) AS v FROM base GROUP BY label), a AS (SELECT id, vector, bucket_id FROM (SELECT id, vector, bucket_id, row_number() OVER (PARTITION BY id ORDER BY {l2_sql('vector', 'v')}, bucket_id) AS r FROM base, st) WHERE r = 1) SELECT bucket_id, round(sum(x), 5) + 0.0 AS total FROM (SELECT bucket_id, pos, avg(x) AS x FROM (SELECT bucket_id, unnest(range(1, 65)) AS pos, unnest(vector)::DOUBLE AS x FROM a) GROUP BY ALL) GROUP BY bucket_id")
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    start = b.groupBy(F.col("label").cast("long").alias("bucket_id")).agg(F.transform(F.min_by("vector", "id"), lambda x: x.cast("double")).alias("centroid"))
    out = ivf.kmeans(b, 10, 1, start=start)
    return rounded(out.select("bucket_id", D.reduce_add(F.col("centroid")).alias("total")), "total", digits=5)


@query()
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.kmeans(base(spark, sf_dir), 16, 10)


# hierarchies


@query(knn_sql(where="path = 'g1' OR starts_with(path, 'g1/')"))
def path_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hierarchy.knn(*both(spark, sf_dir), 10, "g1"))


@query(knn_sql(where="path IN ('g0/l2', 'g1/l3') OR starts_with(path, 'g1/')"))
def path_multi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hierarchy.knn(*both(spark, sf_dir), 10, "g0/l2|g1/l3|g1"))


@query(knn_sql(None, where="path = 'g0/l4'", cut="d <= 1.9"))
def path_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hierarchy.range_search(*both(spark, sf_dir), 1.9, "g0/l4"))


@query(knn_sql(where="starts_with(path_b, 'm1/')"))
def path_named_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hierarchy.knn(*both(spark, sf_dir), 10, "m1", hierarchy="b"))


@query(knn_sql(where="starts_with(path_b, 'm1/') AND starts_with(path, 'g1/')"))
def path_intersection_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hierarchy.combined(*both(spark, sf_dir), 10, {"b": "m1", "": "g1"}, "intersection"))


@query(f"WITH {BASE} SELECT prefix, count(*) AS n_rows FROM (SELECT string_split(path, '/')[1] AS prefix FROM base UNION ALL SELECT path FROM base) GROUP BY prefix")
def path_node_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.node_sizes(base(spark, sf_dir))


# codes

_RANGE = ", sr AS (SELECT list(lo ORDER BY pos) AS low, list(hi - lo ORDER BY pos) AS width FROM (SELECT pos, min(x) AS lo, max(x) AS hi FROM (SELECT unnest(range(1, 65)) AS pos, unnest(vector)::DOUBLE AS x FROM base) GROUP BY pos))"


def _code_sql(top: int) -> str:
    return _RANGE + f", k AS (SELECT id, label, vector, low, width, list_transform(list_zip(vector, low, width), lambda z: floor(CASE WHEN z[3] < 1e-12 THEN 1.0 ELSE least(1.0, greatest(0.0, (z[1]::DOUBLE - z[2]) / z[3])) END * {top})::INTEGER) AS code FROM base, sr), u AS (SELECT id, label, vector AS raw, list_transform(list_zip(code, low, width), lambda z: z[1] / {top} * z[3] + z[2]) AS vector FROM k)"


_UNIFORM = ", ur AS (SELECT min(x) AS lo, max(x) - min(x) AS w FROM (SELECT unnest(vector)::DOUBLE AS x FROM base)), u AS (SELECT id, list_transform(vector, lambda x: floor(least(1.0, greatest(0.0, (x::DOUBLE - lo) / w)) * 255) / 255 * w + lo) AS vector FROM base, ur)"


def coded(spark: SparkSession, sf_dir: str, bits: int) -> tuple[DataFrame, DataFrame, Q.Scalar]:
    b, q = both(spark, sf_dir)
    return b, q, Q.fit_scalar(b, bits)


@query(f"WITH {BASE}{_code_sql(255)} SELECT id, array_to_string(code, ',') AS code FROM k")
def sq8_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, _, m = coded(spark, sf_dir, 8)
    return b.select("id", F.concat_ws(",", m.encode(F.col("vector")).cast("array<string>")).alias("code"))


@query(knn_sql(rows="u", more=_code_sql(255)))
def sq8_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q, m = coded(spark, sf_dir, 8)
    return rounded(index_module.coded_knn(b, m, q, 10))


@query(knn_sql(rows="u", more=_code_sql(15)))
def sq4_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q, m = coded(spark, sf_dir, 4)
    return rounded(index_module.coded_knn(b, m, q, 10))


@query(knn_sql(rows="u", more=_UNIFORM))
def sq8_uniform_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    return rounded(index_module.coded_knn(b, Q.fit_uniform(b, 8), q, 10))


@query(f"WITH {BASE}{_code_sql(15)}, {scores_sql(rows='u').replace('s AS', 'cs AS', 1)}, cand AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS r FROM cs) WHERE r <= 30), s AS (SELECT c.qid, c.id, {l2_sql('b.vector', 'q.q')} AS d FROM cand c JOIN base b ON b.id = c.id JOIN q ON q.qid = c.qid) {top_sql(10)}")
def sq4_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q, m = coded(spark, sf_dir, 4)
    return rounded(index_module.coded_knn(b, m, q, 10, factor=3.0))


@query(f"WITH {BASE}{_code_sql(255)} SELECT round(avg(e), 6) + 0.0 AS mean_error, round(max(e), 6) + 0.0 AS max_error FROM (SELECT unnest(list_transform(list_zip(raw, vector), lambda z: abs(z[1]::DOUBLE - z[2]))) AS e FROM u)")
def quantization_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, _, m = coded(spark, sf_dir, 8)
    return rounded(Q.error(b, m.decode(m.encode(F.col("vector")))), "mean_error", "max_error")


@query(knn_sql(rows="u", more=", u AS (SELECT id, vector[1:16] AS vector FROM base)").replace("q AS (SELECT vec_id AS qid, embedding AS q", "q AS (SELECT vec_id AS qid, embedding[1:16] AS q"))
def mrle_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    return rounded(search.knn(b.withColumn("vector", Q.leading(F.col("vector"), 16)), q.withColumn("q", F.slice("q", 1, 16)), 10))


@query(knn_sql(rows="u", more=", u AS (SELECT id, list_transform(vector, lambda x: floor(greatest(-128, least(127, floor(x::DOUBLE * 127))))) AS vector FROM base)").replace("q AS (SELECT vec_id AS qid, embedding AS q", "q AS (SELECT vec_id AS qid, list_transform(embedding, lambda x: floor(greatest(-128, least(127, floor(x::DOUBLE * 127))))) AS q"))
def int8_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    return rounded(search.knn(b.withColumn("vector", Q.int8(F.col("vector"))), q.withColumn("q", Q.int8(F.col("q"))), 10))


@query()
def bf16_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    return rounded(search.knn(b.withColumn("vector", Q.bf16(F.col("vector"))), q, 10))


@query()
def fp16_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    return rounded(search.knn(b.withColumn("vector", Q.fp16(F.col("vector"))), q, 10))


@query()
def pq_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    return rounded(index_module.coded_knn(b, Q.fit_product(b, 8, 64), q, 10, factor=4.0))


@query()
def pq_code_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between codes, and from a query to codes, by tables."""
    b, q = both(spark, sf_dir)
    m = Q.fit_product(b, 8, 32)
    codes = store.checkpointed(b.select("id", m.encode(F.col("vector")).alias("code")))
    pairs = codes.join(codes.select((F.col("id") - 1).alias("id"), F.col("code").alias("next")), "id")
    return pairs.select("id", F.round(m.between(F.col("code"), F.col("next")), 6).alias("between"), F.round(m.lookup(F.col("code"), q.orderBy("qid").first().q), 6).alias("to_query"))


@query()
def pqfs_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    return rounded(index_module.coded_knn(b, Q.fit_product(b, 16, 16), q, 10, factor=4.0))


@query()
def pca_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    m = Q.fit_pca(b, 32)
    return rounded(search.knn(b.withColumn("vector", m.apply(F.col("vector"))), q.withColumn("q", m.apply(F.col("q"))), 10))


@query(knn_sql(digits=5))
def rotated_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rotation keeps distances."""
    b, q = both(spark, sf_dir)
    m = Q.random_rotation(64)
    return rounded(search.knn(b.withColumn("vector", m.apply(F.col("vector"))), q.withColumn("q", m.apply(F.col("q"))), 10), digits=5)


@query(knn_sql(digits=5))
def hadamard_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    m = Q.hadamard_rotation(64)
    return rounded(search.knn(b.withColumn("vector", m.apply(F.col("vector"))), q.withColumn("q", m.apply(F.col("q"))), 10), digits=5)


@query()
def one_bit_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    m = Q.fit_one_bit(b)
    rows = b.select("id", m.encode(F.col("vector")).alias("code"))
    found = search.candidates(rows, q, "l2", 50, vector="code", decode=m.decoder())
    return rounded(search.rerank(search.ranked(found, 50), b, q, 10))


@query(knn_sql())
def rabitq_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by 8-bit codes of rotated directions, scored again on vectors."""
    b, q = both(spark, sf_dir)
    i = index_module.create("flat|0|rabitq8|fp32", '{"dim": 64, "index_param": {"factor": 10}}')
    i.build(b)
    return rounded(i.search(SearchRequest(q)))


@query(f"WITH {BASE}{_code_sql(15)}, {scores_sql(rows='u').replace('s AS', 'cs AS', 1)}, cand AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS r FROM cs) WHERE r <= 30), s AS (SELECT c.qid, c.id, {l2_sql('b.vector', 'q.q')} AS d FROM cand c JOIN base b ON b.id = c.id JOIN q ON q.qid = c.qid) {top_sql(10)}")
def index_codes_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that searches codes, tuned from one quantizer to another."""
    b, q = both(spark, sf_dir)
    i = index_module.create("flat", '{"dim": 64, "index_param": {"codes": "sq8", "factor": 3}}')
    i.build(b)
    i.tune("sq4")
    return rounded(i.search(SearchRequest(q)))


@query((knn_sql(rows="u", more=_code_sql(255)).replace("range(1, 65)", "range(1, 17)").replace("embedding AS vector", "embedding[1:16] AS vector").replace("embedding AS q ", "embedding[1:16] AS q ")))
def transform_chain_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading dimensions, then 8-bit codes, searched without the vectors."""
    b, q = both(spark, sf_dir)
    i = index_module.create("flat", '{"dim": 64, "index_param": {"codes": "mrle:16,sq8", "precise": null}}')
    i.build(b)
    return rounded(i.search(SearchRequest(q)))


_INVERTED = f", x AS (SELECT qid, id, {l2_sql('raw', 'q')} AS e, {l2_sql('vector', 'q')} AS c FROM u, q), y AS (SELECT qid, id, e, c FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY e, id) AS r FROM x) WHERE r <= 20)"


@query(f"WITH {BASE}{_code_sql(15)}{_INVERTED} SELECT count(*) AS pairs, round(avg(CASE WHEN round(a.c, 9) > round(b.c, 9) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS inverted FROM y a JOIN y b ON a.qid = b.qid AND round(a.e, 9) < round(b.e, 9)")
def quantization_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often codes order two of the nearest twenty differently."""
    b, q, m = coded(spark, sf_dir, 4)
    near = search.knn(b, q, 20).select("qid", "id", F.round("distance", 9).alias("exact"))
    decoded = b.select("id", m.decode(m.encode(F.col("vector"))).alias("vector"))
    both_ = near.join(decoded, "id").join(q, "qid").select("qid", "id", "exact", F.round(D.l2(F.col("vector"), F.col("q")), 9).alias("coded"))
    return rounded(Q.inversions(both_), "inverted")


# vector functions


@query(f"WITH {BASE}, p AS (SELECT b.id, b.vector AS a, c.vector AS c FROM base b JOIN base c ON c.id = b.id + 1) SELECT id, round(list_sum(list_transform(list_zip(a, c), lambda z: z[1]::DOUBLE + z[2]::DOUBLE)), 5) + 0.0 AS plus, round(list_sum(list_transform(list_zip(a, c), lambda z: z[1]::DOUBLE - z[2]::DOUBLE)), 5) + 0.0 AS minus, round({dot_sql('a', 'c')}, 5) + 0.0 AS times, round(list_sum(list_transform(a, lambda x: x::DOUBLE * 3.0)), 5) + 0.0 AS scaled FROM p")
def vector_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    p = b.select("id", F.col("vector").alias("a")).join(b.select((F.col("id") - 1).alias("id"), F.col("vector").alias("c")), "id")
    a, c = F.col("a"), F.col("c")
    out = p.select("id", D.reduce_add(D.add(a, c)).alias("plus"), D.reduce_add(D.subtract(a, c)).alias("minus"), D.reduce_add(D.multiply(a, c)).alias("times"), D.reduce_add(D.scale(a, 3.0)).alias("scaled"))
    return rounded(out, "plus", "minus", "times", "scaled", digits=5)


@query(f"WITH {BASE} SELECT id, round(sqrt({dot_sql('vector', 'vector')}), 5) + 0.0 AS norm, round(list_sum(list_transform(vector, lambda x: x::DOUBLE / sqrt({dot_sql('vector', 'vector')}))), 5) + 0.0 AS total FROM base")
def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return rounded(b.select("id", D.norm(F.col("vector")).alias("norm"), D.reduce_add(D.normalize(F.col("vector"))).alias("total")), "norm", "total", digits=5)


@query("SELECT vec_id AS id, (vec_id % 256) & 15 AS both_bits, (vec_id % 256) | 15 AS either_bits, xor(vec_id % 256, 15) AS one_bit, xor(vec_id % 256, 255) AS no_bit FROM embeddings")
def bit_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = F.array(F.col("id") % 256), F.array(F.lit(15).cast("long"))
    return base(spark, sf_dir).select("id", D.bit_and(a, c)[0].alias("both_bits"), D.bit_or(a, c)[0].alias("either_bits"), D.bit_xor(a, c)[0].alias("one_bit"), D.bit_not(a)[0].alias("no_bit"))


# graphs


def _edges_sql(k: int) -> str:
    return f"e AS (SELECT src, dst, rank, d FROM (SELECT a.id AS src, b.id AS dst, {l2_sql('a.vector', 'b.vector')} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {l2_sql('a.vector', 'b.vector')}, b.id) AS rank FROM base a JOIN base b ON a.id <> b.id) WHERE rank <= {k})"


@query(f"WITH {BASE}, {_edges_sql(5)} SELECT src, dst, rank, round(d, 6) + 0.0 AS distance FROM e")
def knn_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.exact_edges(base(spark, sf_dir), 5))


@query(f"WITH {BASE}, {_edges_sql(5)} SELECT coalesce(o.id, i.id) AS id, coalesce(o.n, 0) AS degree_out, coalesce(i.n, 0) AS degree_in FROM (SELECT src AS id, count(*) AS n FROM e GROUP BY src) o FULL JOIN (SELECT dst AS id, count(*) AS n FROM e GROUP BY dst) i ON o.id = i.id")
def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_stats(graph.exact_edges(base(spark, sf_dir), 5))


@query(f"WITH {BASE}, {_edges_sql(5).replace('e AS', 'e0 AS', 1)} SELECT src + 1000 AS src, dst + 1000 AS dst, round(d, 6) + 0.0 AS distance FROM e0 WHERE src % 3 <> 0 AND dst % 3 <> 0")
def build_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges carried by source ids to an index with other ids and fewer rows."""
    b = base(spark, sf_dir)
    name = F.concat(F.lit("doc-"), F.col("id")).alias("source_id")
    cache = graph.export_cache(graph.exact_edges(b, 5), b.select("id", name))
    return rounded(graph.import_cache(cache, b.filter("id % 3 <> 0").select((F.col("id") + 1000).alias("id"), name)))


@query()
def descent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.descent(base(spark, sf_dir), 8, 4))


@query()
def pruned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return rounded(graph.pruned(b, graph.exact_edges(b, 16), 8))


@query()
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    edges = store.checkpointed(graph.undirected(graph.exact_edges(b, 12)))
    return rounded(graph.search(b, edges, q, 10))


@query(f"WITH RECURSIVE {BASE}, {_edges_sql(3)}, l AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r(a, b) AS (SELECT id, id FROM base UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a AS id, min(b) AS component FROM r GROUP BY a")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(graph.exact_edges(base(spark, sf_dir), 3))


@query(f"WITH {BASE}, u AS (SELECT id, vector FROM base UNION ALL SELECT id + 500000, vector FROM base WHERE id < 20) SELECT id, min(id) OVER (PARTITION BY vector) AS first_id, count(*) OVER (PARTITION BY vector) AS n FROM u QUALIFY n > 1")
def duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).select("id", "vector")
    return graph.duplicates(b.union(b.filter("id < 20").select(F.col("id") + 500_000, "vector")))


@query(knn_sql())
def lazy_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Below its threshold the index is flat; rows that are added take it over, and it is a graph from then on."""
    b, q = both(spark, sf_dir)
    rows = b.count()
    i = index_module.create("lazy_hgraph", f'{{"dim": 64, "index_param": {{"transition_threshold": {rows}, "degree": 24}}}}')
    i.build(b.filter("id % 5 <> 0"))
    flat = "edges" not in i.tables
    i.add(b.filter("id % 5 = 0"))
    if not flat or "edges" not in i.tables:
        raise AssertionError("the index did not switch")
    return rounded(i.search(SearchRequest(q, params={"ef_search": 200})))


def _graph_index(b: DataFrame) -> index_module.Index:
    i = index_module.create("hgraph", '{"dim": 64, "index_param": {"transition_threshold": 100, "degree": 24}}')
    i.build(b)
    return i


@query(knn_sql(where="label = 3 AND id % 8 = 0"))
def graph_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph index answers a filter that few rows pass by an exact scan of those."""
    b, q = both(spark, sf_dir)
    return rounded(_graph_index(b).search(SearchRequest(q, where="label = 3", keep=F.col("id") % 8 == 0, params={"brute_force_threshold": 0.05})))


@query(knn_sql(where="id % 3 <> 1 AND id % 7 <> 2"))
def graph_filtered_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk goes through rows that a filter rejects or that were removed, and k rows that pass come back."""
    b, q = both(spark, sf_dir)
    i = _graph_index(b)
    i.remove(b.filter("id % 7 = 2"))
    return rounded(i.search(SearchRequest(q, keep=F.col("id") % 3 != 1, params={"ef_search": 200})))


@query(knn_sql(where="path = 'g1' OR starts_with(path, 'g1/')"))
def path_graph_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix with enough rows has a graph of its own."""
    b, q = both(spark, sf_dir)
    i = index_module.create("pyramid", '{"dim": 64, "index_param": {"index_min_size": 100, "degree": 24, "no_build_levels": [1]}}')
    i.build(b)
    return rounded(i.search(SearchRequest(q, paths=["g1"], params={"ef_search": 200})))


# diagnosis


@query(f"WITH {BASE}{_code_sql(15)}, {scores_sql()}, {scores_sql(rows='u').replace('s AS', 'cs AS', 1)}, t AS ({top_sql(10)}), r AS ({top_sql(10, frame='cs')}) SELECT t.qid, round(count(r.id) / 10.0, 6) + 0.0 AS recall FROM t LEFT JOIN r ON r.qid = t.qid AND r.id = t.id GROUP BY t.qid")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q, m = coded(spark, sf_dir, 4)
    return rounded(diagnose.recall(index_module.coded_knn(b, m, q, 10), search.knn(b, q, 10)), "recall")


@query(f"WITH {BASE}, {scores_sql()}, t AS ({top_sql(1)}), r AS (SELECT qid, id FROM s WHERE id % 2 = 0) SELECT t.qid, (CASE WHEN count(r.id) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS recall FROM t LEFT JOIN r ON r.qid = t.qid AND r.id = t.id GROUP BY t.qid")
def nearest_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    return diagnose.nearest_found(search.knn(b, q, 10, where=F.col("id") % 2 == 0), search.knn(b, q, 10))


@query(f"WITH {BASE}, {scores_sql()} SELECT qid, round(count(*) FILTER (d <= 1.6) / count(*) FILTER (d <= 1.9), 6) + 0.0 AS ratio FROM s GROUP BY qid")
def range_size_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    return rounded(diagnose.size_ratio(search.range_search(b, q, 1.6), search.range_search(b, q, 1.9)), "ratio")


@query(
    f"WITH {BASE}{_CENTROIDS}{_near_sql(1)}{_ROUTE}, {scores_sql()}, x AS (SELECT qid, id, d FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS r FROM s) WHERE r <= 20), "
    "y AS (SELECT x.*, EXISTS (SELECT 1 FROM a JOIN r3 USING (bucket_id) WHERE a.id = x.id AND r3.qid = x.qid) AS reached, x.id % 4 <> 0 AS passing FROM x), "
    "k AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS r FROM (SELECT s.* FROM s JOIN r3 USING (qid) JOIN a ON a.id = s.id AND a.bucket_id = r3.bucket_id WHERE s.id % 4 <> 0)) "
    "SELECT y.qid, y.id, CASE WHEN k.r <= 5 THEN 'success' WHEN NOT reached THEN 'not_reachable' WHEN NOT passing THEN 'filter_rejected' WHEN k.r <= 8 THEN 'reorder_evicted' ELSE 'ef_too_small' END AS reason FROM y LEFT JOIN k ON k.qid = y.qid AND k.id = y.id"
)
def reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    c = centroids(spark, sf_dir)
    assigned, routed = store.checkpointed(ivf.assign(b, c)), store.checkpointed(ivf.route(q, c, 3))
    reached = assigned.join(routed, "bucket_id").select("qid", "id")
    passing = b.filter("id % 4 <> 0").select("id")
    coarse = ivf.probe(b.filter("id % 4 <> 0"), assigned, routed, q, 8)
    return diagnose.reasons(search.knn(b, q, 20), reached, passing, coarse.withColumn("exact", F.col("distance")), coarse, coarse.filter("rank <= 5"))


@query()
def autotune(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    c = store.checkpointed(ivf.kmeans(b, 16, 5))
    assigned = store.checkpointed(ivf.assign(b, c))
    return diagnose.tune(spark, {"probes": [1, 4, 16]}, lambda p: ivf.probe(b, assigned, ivf.route(q, c, p["probes"]), q, 10), search.knn(b, q, 10), 0.9)


# saving and streams


@query(knn_sql())
def save_load_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = both(spark, sf_dir)
    path = f"{_folder(spark)}/saved"
    i = index_module.create("brute_force", '{"dim": 64}')
    i.build(b)
    i.save(spark, path)
    j = index_module.create("brute_force", '{"dim": 64}')
    j.load(spark, path)
    return rounded(j.search(SearchRequest(q)))


def _folder(spark: SparkSession) -> str:
    import uuid

    return f"{store.shared_dir(spark)}/{uuid.uuid4().hex}"


@query("SELECT user_id AS id, arg_max(value, event_id) AS value FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of apply_log, as a stream of files."""
    folder = _folder(spark)
    log = read(spark, sf_dir, "events").filter("event_type in ('signup', 'purchase', 'error')")
    log = log.select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"), "value")
    low, high = (r := log.agg(F.min("at"), F.max("at")).first())[0], r[1]
    for part in range(3):
        cut = (F.floor((F.col("at") - low) * 3 / (high - low + 1)) == part)
        log.filter(cut).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    ingest = Ingest(spark, f"{folder}/table", log.select("id", "value").limit(0))
    changes = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    ingest.start(changes, f"{folder}/checkpoint").awaitTermination()
    return ingest.current()
