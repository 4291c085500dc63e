import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import index as I
from nearfield.errors import InvalidArgument, NotEmpty, UnsupportedOperation
from nearfield.functions import distance as D
from nearfield.functions import quantize as Q
from nearfield.operators import diagnose, graph, ivf, mutate, search, sparse
from nearfield.plans.request import IndexConfig, SearchRequest, quick
from nearfield.sources import vectors as V

RNG = np.random.default_rng(42)
X = RNG.normal(size=(300, 16)).astype(np.float32)


@pytest.fixture(scope="module")
def base(spark):
    return V.dense(spark, X).cache()


@pytest.fixture(scope="module")
def queries(base):
    return base.filter("id < 6").select(F.col("id").alias("qid"), F.col("vector").alias("q"))


def truth(metric, k=10, keep=None):
    a = X.astype(float)
    d = {"l2": ((a[:6, None] - a[None]) ** 2).sum(2), "ip": 1 - a[:6] @ a.T, "cosine": 1 - (a[:6] @ a.T) / np.outer(np.linalg.norm(a[:6], axis=1), np.linalg.norm(a, axis=1))}[metric]
    if keep is not None:
        d = np.where(keep[None], d, np.inf)
    return {q: np.argsort(d[q], kind="stable")[:k].tolist() for q in range(6)}


def ids(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append(r.id)
    return out


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_knn_equals_brute_force(base, queries, metric):
    assert ids(search.knn(base, queries, 10, metric)) == truth(metric)
    assert ids(search.knn_by_expression(base, queries, 10, D.distance(metric))) == truth(metric)


def test_filter_comes_first(base, queries):
    assert ids(search.knn(base, queries, 10, where=F.col("id") % 3 == 0)) == truth("l2", keep=np.arange(300) % 3 == 0)


def test_range_and_limits(base, queries):
    every = search.range_search(base, queries, 20.0).collect()
    assert every and all(r.distance <= 20.0 for r in every)
    assert max(r["rank"] for r in search.range_search(base, queries, 20.0, limit=3).collect()) <= 3
    with pytest.raises(InvalidArgument):
        search.range_search(base, queries, 1.0, limit=0)
    with pytest.raises(InvalidArgument):
        search.range_search(base, queries, -1.0)


def test_non_finite_and_short(spark, queries):
    b = V.dense(spark, np.array([[np.nan] * 16, [np.inf] * 16, [1.0] * 16], np.float32))
    got = search.knn(b, queries.limit(1), 5).collect()
    assert [r.id for r in got] == [2]
    assert search.knn(b.limit(0), queries, 5).count() == 0


def test_pages_never_repeat(base, queries):
    i = I.create("flat", '{"dim": 16}')
    i.build(base)
    seen, pages = set(), 0
    for page in i.pages(SearchRequest(queries.limit(2), k=70)):
        new = {(r.qid, r.id) for r in page}
        assert not new & seen
        seen |= new
        pages += 1
    assert len(seen) == 600 and pages == 5


def test_distance_by_ids(spark, base, queries):
    wanted = spark.createDataFrame([(0, 0), (0, 5), (0, 9999)], "qid long, id long")
    got = {r.id: r.distance for r in search.distance_by_ids(base, queries, wanted).collect()}
    assert got[0] == 0 and got[9999] == -1.0
    top = search.distance_by_ids(base, queries, wanted, topk=2).collect()
    assert sorted(r.id for r in top) == [0, 5]


def test_custom_distance_must_be_finite(base, queries):
    with pytest.raises(Exception, match="not finite"):
        search.knn_by_expression(base, queries, 3, lambda a, b: F.lit(float("nan"))).collect()


def test_mutations(spark, base):
    more = V.dense(spark, X[:3], np.array([5, 1000, 1000]))
    rows, failed = mutate.add(base, more)
    assert rows.count() == 301 and sorted(r.id for r in failed.collect()) == [5, 1000]
    assert mutate.alive(base, base.filter("id < 10")).count() == 290
    assert mutate.merge(base, base, F.col("id") + 1000).agg(F.max("id")).first()[0] == 1299
    changed = mutate.update(base, base.filter("id = 1").select(F.lit(2).cast("long").alias("id"), "vector"), ["vector"])
    assert changed.filter("id = 2").first().vector == base.filter("id = 1").first().vector


def test_ivf_all_probes_is_exact(base, queries):
    c = ivf.kmeans(base, 8, 4)
    got = ivf.probe(base, ivf.assign(base, c), ivf.route(queries, c, 8), queries, 10)
    assert ids(got) == truth("l2")
    part = ivf.probe(base, ivf.assign(base, c, 2), ivf.route(queries, c, 4), queries, 10)
    assert diagnose.recall(part, search.knn(base, queries, 10)).agg(F.avg("recall")).first()[0] > 0.7
    with pytest.raises(InvalidArgument):
        ivf.chosen(queries, [1, 1], 8)


def test_graph(base, queries):
    edges = graph.descent(base, 12, 4)
    exact = graph.exact_edges(base, 12)
    hit = edges.join(exact.select("src", "dst"), ["src", "dst"]).count()
    assert hit / exact.count() > 0.85
    got = graph.search(base, graph.undirected(edges), queries, 10, beam=60)
    assert diagnose.recall(got, search.knn(base, queries, 10)).agg(F.avg("recall")).first()[0] >= 0.9
    assert graph.pruned(base, exact, 6).groupBy("src").count().agg(F.max("count")).first()[0] <= 6


def test_components(spark):
    e = spark.createDataFrame([(1, 2, 0.0), (2, 3, 0.0), (10, 11, 0.0), (11, 12, 0.0), (12, 13, 0.0)], "src long, dst long, distance double")
    assert {r.id: r.component for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10}


def test_quantizers(base, queries):
    for model in (Q.fit_scalar(base, 8), Q.fit_uniform(base, 8), Q.fit_product(base, 4, 64)):
        got = I.coded_knn(base, model, queries, 10, factor=4.0)
        assert diagnose.recall(got, search.knn(base, queries, 10)).agg(F.avg("recall")).first()[0] >= 0.9
    codes = base.select(Q.fit_scalar(base, 4).encode(F.col("vector")).alias("c")).collect()
    assert {x for r in codes for x in r.c} == set(range(16))


def test_one_bit_estimates(base):
    m = Q.fit_one_bit(base)
    rows = base.select("id", m.encode(F.col("vector")).alias("code"))
    got = {r.id: r.d for r in rows.select("id", m.distance(F.col("code"), X[0].tolist()).alias("d")).collect()}
    exact = ((X[0].astype(float) - X.astype(float)) ** 2).sum(1)
    assert np.corrcoef([got[i] for i in range(300)], exact)[0, 1] > 0.7


def test_sparse(spark):
    rows = V.sparse(spark, np.array([0, 2, 3, 3]), np.array([1, 2, 2]), np.array([1.0, 2.0, 3.0]))
    p = sparse.from_arrays(rows)
    q = spark.createDataFrame([(0, 2, 1.0), (0, 9, 5.0)], "qid long, term long, weight double")
    assert [(r.id, r.distance) for r in sparse.knn(p, q, 5).orderBy("rank").collect()] == [(1, -2.0), (0, -1.0)]
    assert sparse.prune_queries(q, 0.9).count() == 1


def test_sparse_stream(spark):
    import struct

    one = struct.pack("<I2I2f", 2, 7, 9, 0.5, 1.5)
    assert V.decode_sparse(one * 2) == [([7, 9], [0.5, 1.5])] * 2
    with pytest.raises(InvalidArgument):
        V.decode_sparse(one[:-1])
    got = V.sparse_stream(spark.createDataFrame([(3, bytearray(one))], "id long, data binary")).first()
    assert (got.id, got.ids, got.vals) == (3, [7, 9], [0.5, 1.5])


def test_save_load_clone(spark, base, queries, tmp_path):
    i = I.create("ivf", '{"dim": 16, "index_param": {"buckets": 4}}')
    i.build(base)
    i.save(spark, str(tmp_path / "i"))
    j = I.create("ivf", '{"dim": 16}')
    j.load(spark, str(tmp_path / "i"))
    r = SearchRequest(queries, params={"scan_buckets_count": 4})
    assert ids(j.search(r)) == ids(i.search(r)) == truth("l2")
    with pytest.raises(NotEmpty):
        j.load(spark, str(tmp_path / "i"))
    k = i.clone()
    k.set_immutable()
    with pytest.raises(UnsupportedOperation):
        k.remove(base.limit(1))


def test_indexes(spark, base, queries):
    for kind, params in (("hgraph", '{"transition_threshold": 100, "degree": 12}'), ("lazy_hgraph", "{}"), ("brute_force", "{}")):
        i = I.create(kind, f'{{"dim": 16, "index_param": {params}}}')
        i.build(base)
        got = i.search(SearchRequest(queries, params={"ef_search": 60}))
        assert diagnose.recall(got, search.knn(base, queries, 10)).agg(F.avg("recall")).first()[0] >= 0.95
    docs = base.select(F.expr("id div 3").alias("id"), F.col("id").alias("at"), "vector")
    from nearfield.operators import multivector

    docs = multivector.gather(docs)
    q = docs.filter("id < 3").select(F.col("id").alias("qid"), "vectors")
    simq = I.create("simq", '{"representation": "multi_vector", "metric_type": "ip", "index_param": {"clusters": 6}}')
    simq.build(docs)
    warp = I.create("warp", '{"representation": "multi_vector", "metric_type": "ip"}')
    warp.build(docs)
    assert ids(simq.search(SearchRequest(q, k=5, params={"coarse_k": 6}))) == ids(warp.search(SearchRequest(q, k=5)))


def test_graph_fills_k_under_a_filter(base, queries):
    i = I.create("hgraph", '{"dim": 16, "index_param": {"transition_threshold": 100, "degree": 12}}')
    i.build(base)
    keep = F.col("id") % 10 == 0
    got = i.search(SearchRequest(queries, k=10, keep=keep, params={"ef_search": 10, "hops_limit": 1})).groupBy("qid").count().collect()
    assert len(got) == queries.count() and {r["count"] for r in got} == {min(10, base.filter(keep).count())}


def test_configuration():
    assert quick("hgraph|32|sq8|fp32") == {"kind": "hgraph", "degree": 32, "codes": "sq8", "precise": "fp32"}
    for bad in ({"kind": "flat"}, {"kind": "flat", "dim": 0}, {"kind": "flat", "dim": 4, "metric": "x"}, {"kind": "sindi", "dtype": "sparse", "metric": "l2"}):
        with pytest.raises(InvalidArgument):
            IndexConfig(**bad)
    with pytest.raises(InvalidArgument):
        I.create("nothing", '{"dim": 4}')
    with pytest.raises(UnsupportedOperation):
        SearchRequest(None, params={"timeout_ms": 3})


def test_query_sets_beyond_a_plan_are_answered_in_parts(base, queries, monkeypatch):
    whole = ids(search.knn(base, queries, 5))
    every = {(r.qid, r.id) for r in search.range_search(base, queries, 20.0).collect()}
    own = ids(search.knn_by_expression(base, queries, 5, D.l2))
    monkeypatch.setattr(search, "BLOCK", 2)
    monkeypatch.setattr(search, "BLOCKS", 1)
    assert ids(search.knn(base, queries, 5)) == whole == own == ids(search.knn_by_expression(base, queries, 5, D.l2))
    assert {(r.qid, r.id) for r in search.range_search(base, queries, 20.0).collect()} == every


def test_products_are_scored_again_directly(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(200, 8)) * 1e-3 + 1e4).astype(np.float32)  # where a product alone loses all digits
    b = V.dense(spark, x)
    q = b.filter("id < 3").select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    a = x.astype(float)
    for r in search.knn(b, q, 4).collect():
        assert r.distance == ((a[r.qid] - a[r.id]) ** 2).sum()
        assert (((a[r.qid] - a) ** 2).sum(axis=1) < r.distance).sum() < r["rank"]


def test_more_bits_tell_more(base, queries):
    truth_ = search.knn(base, queries, 10)
    recalls = [diagnose.recall(I.coded_knn(base, Q.fit_rotated(base, bits), queries, 10), truth_).agg(F.avg("recall")).first()[0] for bits in (1, 4, 8)]
    assert recalls[0] < recalls[1] < recalls[2] and recalls[2] > 0.95
    with pytest.raises(InvalidArgument):
        Q.fit_rotated(base, 9)


def test_chain_is_its_parts(base):
    chain = Q.fit_chain(base, "rom,mrle:4")
    m = Q.random_rotation(16).matrix[:, :4]
    got = np.array([r.y for r in base.select("id", chain.apply(F.col("vector")).alias("y")).orderBy("id").collect()])
    assert np.allclose(got, X.astype(float) @ m)
    again = Q.from_json(Q.to_json(Q.fit_chain(base, "pca:8,sq8")))
    assert isinstance(again.bottom, Q.Scalar) and again.linear.matrix.shape == (16, 8)
    for bad in ("residual", "sq8,rom", "normalize,sq8"):
        with pytest.raises(InvalidArgument):
            Q.fit_chain(base, bad)


def test_codes_in_an_index(spark, base, queries, tmp_path):
    i = I.create("flat|0|sq8|fp32", '{"dim": 16, "index_param": {"factor": 6}}')
    i.build(base.filter("id < 250"))
    i.add(base.filter("id >= 250"))
    assert ids(i.search(SearchRequest(queries))) == truth("l2")
    i.save(spark, str(tmp_path / "c"))
    j = I.create("flat", '{"dim": 16}')
    j.load(spark, str(tmp_path / "c"))
    assert ids(j.search(SearchRequest(queries))) == truth("l2")
    j.tune("rabitq4", precise=None)
    assert diagnose.recall(j.search(SearchRequest(queries)), search.knn(base, queries, 10)).agg(F.avg("recall")).first()[0] > 0.7
    assert {r.component for r in j.detail(spark).collect()} == {"rows"}
    r = I.create("ivf", '{"dim": 16, "index_param": {"buckets": 4, "codes": "sq8", "use_residual": true, "factor": 6}}')
    r.build(base)
    assert ids(r.search(SearchRequest(queries, params={"scan_buckets_count": 4}))) == truth("l2")


def test_a_build_goes_on_after_a_failure(base, queries, tmp_path):
    import shutil

    i = I.create("flat", '{"dim": 16}')
    assert i.continue_build(base, str(tmp_path / "b"), parts=4) == 4
    shutil.rmtree(tmp_path / "b" / "part=2")
    j = I.create("flat", '{"dim": 16}')
    assert j.continue_build(base, str(tmp_path / "b"), parts=4) == 1
    assert ids(j.search(SearchRequest(queries))) == truth("l2")


def test_sparse_index_changes(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, term long, weight double")
    q = spark.createDataFrame([(0, 2, 1.0)], "qid long, term long, weight double")
    i = I.create("sindi", '{"dtype": "sparse", "metric_type": "ip", "representation": "sparse"}')
    i.build(rows((1, 2, 1.0), (1, 3, 1.0), (2, 2, 5.0)))
    assert [r.id for r in i.add(rows((2, 2, 9.0), (3, 2, 3.0), (3, 4, 1.0))).collect()] == [2]
    assert ids(i.search(SearchRequest(q))) == {0: [2, 3, 1]} and i.count() == (3, 0)
    assert i.tables["rows"].filter("id = 3").count() == 2
    i.remove(rows((2, 0, 0.0)), force=True)
    i.update_id(3, 9)
    assert ids(i.search(SearchRequest(q))) == {0: [9, 1]}
    other = i.clone()
    other.tables["rows"] = rows((5, 2, 2.0))
    i.merge(other)
    i.remove(rows((1, 0, 0.0)))
    assert ids(i.search(SearchRequest(q))) == {0: [9, 5]} and i.count() == (2, 1)


def test_hierarchies_by_the_index(base, queries):
    b = base.withColumn("path", F.concat(F.lit("a/b"), F.col("id") % 2)).withColumn("path_x", F.concat(F.lit("x"), F.col("id") % 3))
    i = I.create("pyramid", '{"dim": 16, "index_param": {"index_min_size": 60, "no_build_levels": [0], "degree": 12}}')
    i.build(b)
    assert ids(i.search(SearchRequest(queries, paths=["x1"], hierarchy="x"))) == truth("l2", keep=np.arange(300) % 3 == 1)
    assert ids(i.search(SearchRequest(queries, paths=["a"]))) == truth("l2")
    assert ids(i.search(SearchRequest(queries, paths=["a/b1"], params={"ef_search": 120}))) == truth("l2", keep=np.arange(300) % 2 == 1)
    with pytest.raises(InvalidArgument):
        i.search(SearchRequest(queries, paths=["a"], hierarchy="none"))


def test_measures(base, queries):
    got = diagnose.analyze(lambda: search.knn(base, queries, 10), search.knn(base, queries, 10))
    assert got["recall"] == 1 and got["bias"] == 0
    assert diagnose.export({"recall": 1.0}, "line", "s", {"k": "10"}) == "s,k=10 recall=1.0" and '"recall": 1.0' in diagnose.export({"recall": 1.0}, "json")
    exact = graph.exact_edges(base, 4)
    r = diagnose.edge_quality(exact.filter("rank <= 2"), exact).first()
    assert r.recall == 0.5 and r.mean_distance < r.exact_distance


def test_many_query_blocks_do_not_multiply_shuffled_rows(base, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 4)
    whole = base.repartition(40).select("id", "vector")
    q = whole.filter("id < 32").select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    found = search.candidates(whole, q, "l2", 3)  # was k rows for each of the base's 40 partitions
    assert found.rdd.getNumPartitions() <= 8 * search.SHARES
    a = X.astype(float)
    d = ((a[:32, None] - a[None]) ** 2).sum(2)
    assert {q: r[:3] for q, r in ids(search.ranked(found, 3)).items()} == {q: np.argsort(d[q], kind="stable")[:3].tolist() for q in range(32)}


def test_single_precision_only_bounds():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(400, 8)), rng.normal(size=(20, 8)) * 1e18, np.full((1, 8), np.nan), np.zeros((1, 8)), rng.normal(size=(30, 8)) * 1e-24, np.ones((9, 8))])
    for metric in ("l2", "ip", "cosine"):
        q, number = x[::7], np.arange(len(x))
        for k, radius in ((5, None), (5, 1.5), (None, 1.5)):
            best, asked = search.Best(len(q), k, radius), search.Asked(q, metric)
            for at in range(0, len(x), 64):
                best.add(number[at : at + 64], x[at : at + 64], asked, np.arange(len(q)))
            j, found, _ = best.take()
            for i in range(len(q)):
                d = search.direct(x, np.repeat(q[i : i + 1], len(x), 0), metric)
                want = [n for n in np.lexsort((number, d)) if np.isfinite(d[n]) and (radius is None or d[n] <= radius)][:k]
                assert set(found[j == i].tolist()) == set(want), (metric, k, radius, i)


def test_a_walk_misses_nothing(base, queries):
    """A walk that meets few rows bounds a scan, so the answer is whole."""
    for params in ({"ef_search": 10, "hops_limit": 1}, {"ef_search": 10, "hops_limit": 3}):
        i = I.create("hgraph", '{"dim": 16, "index_param": {"transition_threshold": 100, "degree": 4, "rounds": 1}}')
        i.build(base)
        assert ids(i.search(SearchRequest(queries, params=params))) == truth("l2")
    c = ivf.kmeans(base, 2, 2)
    lists = ivf.listed(base, c)
    edges = ivf.bucket_edges(base, lists.select("id", "bucket_id"), 1)
    assert ids(ivf.graph_probe(lists, edges, ivf.route(queries, c, 2), queries, 10, beam=10)) == truth("l2")


def test_a_large_bucket_is_dealt_to_tasks(base, queries, monkeypatch):
    assigned = base.select("id", (F.col("id") % 2).alias("bucket_id"))

    def rows(edges):
        out = {}
        for r in sorted(edges.collect(), key=lambda r: (r.distance, r.dst)):
            out.setdefault((r.bucket_id, r.src), []).append(r.dst)
        return out

    whole = rows(ivf.bucket_edges(base, assigned, 3))
    a = X.astype(float)
    for i in range(0, 300, 37):
        others = np.array([j for j in range(300) if j % 2 == i % 2 and j != i])
        assert whole[i % 2, i] == others[np.argsort(((a[others] - a[i]) ** 2).sum(1), kind="stable")[:3]].tolist()
    monkeypatch.setattr(ivf, "CELL", 40)

    def grouped(*_):
        raise AssertionError("a bucket of more than CELL rows meets in a task")

    from pyspark.sql import GroupedData

    apply = GroupedData.applyInArrow
    monkeypatch.setattr(type(base.groupBy("id")), "applyInArrow", lambda self, f, s: apply(self, lambda t: f(t) if t.num_rows <= 40 else grouped(), s))
    assert rows(ivf.bucket_edges(base, assigned, 3)) == whole
    lists = base.select((F.col("id") % 2).alias("bucket_id"), "id", "vector")
    routed = queries.select("qid", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("bucket_id"))
    monkeypatch.setattr(type(base.groupBy("id")), "applyInArrow", apply)
    assert ids(ivf.graph_probe(lists, ivf.bucket_edges(base, assigned, 3), routed, queries, 10)) == truth("l2")


def test_descent_ships_vectors_by_node_not_by_pair(base):
    """Rows that have a neighbour in common meet at it: no join of pairs with both ends' vectors."""
    met = graph._met(base.select((F.col("id") % 7).alias("cell"), "id", "vector", F.lit(None).cast("double").alias("cut"), (F.col("id") % 2 == 0).alias("asks"), F.lit(True).alias("offered")), "l2")
    got = {(r.src, r.dst): r.distance for r in met.collect()}
    a = X.astype(float)
    assert got == {(i, j): ((a[i] - a[j]) ** 2).sum() for i in range(0, 300, 2) for j in range(i % 7, 300, 7) if i != j}


def test_pruning_keeps_what_is_not_hidden(base):
    exact = graph.exact_edges(base, 12)
    got = {}
    for r in graph.pruned(base, exact, 6).collect():
        got.setdefault(r.src, set()).add(r.dst)
    a, mine = X.astype(float), {}
    for r in sorted(exact.collect(), key=lambda r: (r.src, r.distance, r.dst)):
        kept = mine.setdefault(r.src, [])
        if len(kept) < 6 and not any(1.2 * ((a[s] - a[r.dst]) ** 2).sum() < r.distance for s in kept):
            kept.append(r.dst)
    assert got == {s: set(v) for s, v in mine.items()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_with_one_exchange(spark):
    docs = spark.createDataFrame([(1, "aa bb aa c"), (120, "bb aa cc"), (1, "aa dd"), (7, None), (8, "x 1"), (3, "dd dd aa")], "doc_id long, text string")
    lists = sparse.posting_rank(sparse.tokens(docs, "doc_id", window_size=100))
    assert plan(lists).count("Exchange hashpartitioning") == 1
    got = {(r.window, r.term, r.id, r.weight, r["rank"]) for r in lists.collect()}
    assert got == {(0, "aa", 1, 3.0, 1), (0, "aa", 3, 1.0, 2), (0, "bb", 1, 1.0, 1), (0, "dd", 1, 1.0, 2), (0, "dd", 3, 2.0, 1), (1, "aa", 120, 1.0, 1), (1, "bb", 120, 1.0, 1), (1, "cc", 120, 1.0, 1)}
    pruned = sparse.prune_documents(sparse.tokens(docs, "doc_id"), 0.4)
    assert plan(pruned).count("Exchange hashpartitioning") == 1
    assert {(r.id, r.term, r.weight) for r in pruned.collect()} == {(1, "aa", 3.0), (120, "aa", 1.0), (120, "bb", 1.0), (3, "dd", 2.0)}


def test_maxsim_by_products(spark):
    from nearfield.operators import multivector

    rng = np.random.default_rng(9)
    docs = [rng.normal(size=(1 + i % 5, 8)).astype(np.float32) for i in range(120)] + [np.zeros((0, 8), np.float32)]
    frame = spark.createDataFrame([(i, d.tolist()) for i, d in enumerate(docs)], "id long, vectors array<array<float>>").repartition(3)
    q = frame.filter("id % 20 = 3").select(F.col("id").alias("qid"), "vectors")
    for metric in ("ip", "l2"):
        d = {}
        for i in range(3, 120, 20):
            for j, x in enumerate(docs[:120]):
                a, b = docs[i].astype(float), x.astype(float)
                d[i, j] = (1 - a @ b.T if metric == "ip" else ((a[:, None] - b[None]) ** 2).sum(2)).min(axis=1).sum()
        want = {i: sorted(range(120), key=lambda j: (d[i, j], j)) for i in range(3, 120, 20)}
        assert ids(multivector.knn(frame, q, 5, metric)) == {i: w[:5] for i, w in want.items()}
        assert multivector.scored(frame, q, metric, 5).count() <= 6 * 5 * 3  # not a row for each pair
        radius = 0.5 if metric == "ip" else 12.0
        assert {(r.qid, r.id) for r in multivector.range_search(frame, q, radius, metric).collect()} == {p for p, v in d.items() if v <= radius}
        assert multivector.range_search(frame, q, radius, metric).filter("abs(distance) > 1e9").count() == 0
    tokens = frame.select("id", F.posexplode("vectors").alias("at", "vector"))
    c = ivf.kmeans(tokens.select(F.xxhash64("id", "at").alias("id"), "vector"), 4, 2)
    members = multivector.cluster(tokens, c).cache()
    found = multivector.coarse(members, q.select("qid", F.posexplode("vectors").alias("at", "vector")), c, 2, 7)
    cents = np.array([r.centroid for r in c.orderBy("bucket_id").collect()])
    held = {}
    for r in members.collect():
        held.setdefault(r.id, set()).add(r.bucket_id)
    for i in range(3, 120, 20):
        dist = 1 - docs[i].astype(float) @ cents.T
        score = {j: sum(max(1 - row[b] for b in near & held[j]) for row in dist if (near := set(np.argsort(row, kind="stable")[:2].tolist())) & held[j]) for j in held if any(set(np.argsort(row, kind="stable")[:2].tolist()) & held[j] for row in dist)}
        got = [(r.id, r.score) for r in found.filter(F.col("qid") == i).orderBy(F.desc("score"), "id").collect()]
        assert np.allclose([s for _, s in got], sorted(score.values(), reverse=True)[:7]) and all(abs(score[j] - s) < 1e-9 for j, s in got)


def test_own_distances_return_the_best_of_a_task(base, queries):
    assert "Cartesian" not in plan(search.knn_by_expression(base, queries, 5, D.cosine)) and "NestedLoop" not in plan(search.knn_by_expression(base, queries, 5, D.cosine))
    every = base.join(F.broadcast(queries)).select("qid", "id", D.l2(F.col("vector"), F.col("q")).alias("distance")).repartition(3)
    assert search._narrowed(every, 4).count() <= 6 * 4 * 3
    assert ids(search.knn_by_expression(base, queries, 10, lambda a, b: D.l2(a, b))) == truth("l2")
    bad = base.select("id", F.when(F.col("id") == 7, F.array_repeat(F.lit(float("nan")).cast("float"), 16)).otherwise(F.col("vector")).alias("vector"))
    with pytest.raises(Exception, match="not finite"):
        search.knn_by_expression(bad, queries, 5, D.cosine).collect()


def test_product_codes_of_many_rows(base):
    """Codes do not depend on how many rows are measured at a time."""
    m = Q.fit_product(base, 4, 64)
    x = X.astype(float).reshape(300, 4, -1)
    want = ((x[:, :, None] - m.centroids[None]) ** 2).sum(axis=3).argmin(axis=2)
    got = {r.id: r.c for r in base.coalesce(1).select("id", m.encode(F.col("vector")).alias("c")).collect()}
    assert [got[i] for i in range(300)] == want.tolist()
