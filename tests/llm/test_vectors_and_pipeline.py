import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearfield.llm import neardup, queries
from nearfield.llm.common import table


def brute(rows, threshold=0.93):
    good = [(i, np.array(v, np.float64)) for i, (_, v, l) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    out = collections.Counter()
    for i, r in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None), default=None)
        out[r[0], links[i], least, r[0] == least] += 1
    return out


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_odd_vectors(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e, 0), (2, e, 0), (2, e, 0), (3, [0.0, 0.0, 0.0], 0), (4, None, 0), (5, e, None), (6, [1.0, None, 0.0], 0), (7, [float("nan"), 1.0, 0.0], 0), (8, [2.0, 0.1, 0.0], 0), (9, e, 1), (10, [1.0, 0.0], 0), (11, [], 0), (12, [-1.0, -0.0, 0.0], 0), (13, [float("inf"), 0.0, 0.0], 0)]
    got = neardup.link(spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)))
    assert collections.Counter(map(tuple, got.drop("recall").collect())) == brute(rows)
    assert neardup.link(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cosine_is_computed_in_doubles(spark):
    rows = [(1, [1e-60, 0.0], 0), (2, [0.0, 1e-60], 0), (3, [1e300, 0.0], 0), (4, [1e-300, 0.0], 0), (5, [0.0, 1e200], 0), (6, [0.93, (1 - 0.93**2) ** 0.5 + 1e-12], 0)]
    got = neardup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r.vec_id: (r.n_links, r.component_id, r.recall) for r in got.collect()} == {1: (2, 1, 1.0), 2: (1, 2, 1.0), 3: (2, 1, 1.0), 4: (2, 1, 1.0), 5: (1, 2, 1.0), 6: (0, 6, 1.0)}


def test_reruns_agree_however_rows_are_dealt(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(60, 16)), 12, axis=0) + rng.normal(size=(720, 16)) * 0.25
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    s = neardup.Settings(cell=80, target=40, recall=0.0)
    first = neardup.link(df, s).collect()
    assert collections.Counter(first) == collections.Counter(neardup.link(df.repartition(7), s).collect())


def test_groups_across_cells(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(500, 24))
    tight = base[:3].repeat(60, axis=0) + rng.normal(size=(180, 24)) * 0.12
    rows = [(i, x.astype(np.float32).tolist(), i % 2) for i, x in enumerate(np.concatenate([base, tight]))]
    s = neardup.Settings(cell=80, target=40)
    got = collections.Counter(map(tuple, neardup.link(spark.createDataFrame(rows, SCHEMA), s).drop("recall").collect()))
    want = brute([(i, np.array(v, np.float32).tolist(), l) for i, v, l in rows])
    found, there = sum(k[1] * n for k, n in got.items()), sum(k[1] * n for k, n in want.items())
    assert there > 1000 and 0.9 * there <= found <= there
    assert sum((got & want).values()) > 0.9 * len(rows)


def tight_rows(n):
    rng = np.random.default_rng(5)
    x = rng.normal(size=32)
    rows = (x / np.linalg.norm(x) + rng.normal(size=(n, 32)) * 0.03).astype(np.float32)
    return [(i, v.tolist(), 0) for i, v in enumerate(rows)]


@pytest.mark.parametrize("more", [{}, {"rounds": 0}])
def test_tight_group_is_compared_exactly(spark, more):
    rows = tight_rows(600)
    s = neardup.Settings(cell=80, target=40, block=150, **more)
    got = collections.Counter(map(tuple, neardup.link(spark.createDataFrame(rows, SCHEMA), s).drop("recall").collect()))
    assert got == brute(rows)


@pytest.fixture(scope="module")
def stages(spark, sf):
    out, docs = [], table(spark, sf, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, corpus_pipeline.spill(stage(spark, docs, sf), f"test{k}")
        out.append((before, docs))
    return out


def test_stages_keep_the_columns(stages):
    for before, after in stages[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString()
        assert 0 < after.count()


def test_clean_documents_stay(stages):
    before, after = stages[0]
    assert after.count() >= before.filter("length(text) > 20").count() * 0.99
    before, after = stages[1]
    lost = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    texts = collections.Counter(x for r in before.collect() for x in set(r.text.split("\n")))
    assert all(max(texts[x] for x in r.text.split("\n")) > 1 for r in before.collect() if r.doc_id in lost)
    before, after = stages[2]
    from tests.llm.test_text_operators import brute_jaccard

    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {k[1] for k in brute_jaccard(rows)}


def test_packed_output_is_the_mixture(stages):
    before, after = stages[4]
    whole = queries.packed(before)
    assert after.agg(F.sum("length")).first()[0] == whole.agg(F.sum("length")).first()[0]


def test_stage_on_nothing(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.spill(stage(spark, docs, sf), f"none{k}")
    assert docs.count() == 0
