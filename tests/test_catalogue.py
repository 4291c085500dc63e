import duckdb
import pytest

from nearfield import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def test_sql_covers_known_queries():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


@pytest.mark.parametrize("name", ["knn_l2", "knn_cosine", "range_limited", "knn_attr_and_or", "distance_by_ids_topk", "sparse_rerank", "maxsim_knn", "ivf_multi_assign", "path_multi_knn", "sq4_rerank", "reasoning", "streaming_ingest", "save_load_knn", "sparse_add_remove", "ivf_residual_sq8_knn", "ivf_graph_probe_knn", "graph_filtered_knn", "path_graph_knn", "rabitq_knn", "index_codes_knn", "transform_chain_knn", "quantization_inversions", "sparse_postings", "range_l2", "knn_padded", "int8_knn", "maxsim_range", "ivf_range"])
def test_equals_sql(spark, sf, duck, name):
    mine = catalogue.QUERIES[name](spark, sf).toPandas()
    theirs = duck.execute(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(mine.columns) == columns
    rows = lambda df: sorted(map(repr, df[columns].itertuples(index=False, name=None)))
    assert rows(mine) == rows(theirs)
