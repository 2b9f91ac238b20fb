"""The graph index against the exact search: recall, compared rows, copies, odd rows, reopening."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowkeel.operators import graph_index, neighbors

ROWS = "id bigint, embedding array<float>"


def rows_of(m, first=0):
    return [(first + i, [float(x) for x in v]) for i, v in enumerate(m)]


def measured(index, corpus, queries, k, id_col="id", **options):
    found, walked = graph_index.search_graph(index, queries, k, id_col, **options)
    found = found.collect()
    true = neighbors.knn(queries, corpus, k, id_col)
    got = corpus.sparkSession.createDataFrame(found, "query_id bigint, neighbor_id bigint, similarity double, rank int")
    r = graph_index.recall_of(got, true).first()
    share = walked.agg(F.avg("compared")).first()[0] / corpus.count()
    return r.found_pairs / r.true_pairs, share, found


def test_recall_and_compared_share_of_the_given_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = graph_index.build_graph(e, "vec_id")
    # whatever the table, a node has a bounded list
    assert index.links.agg(F.max(F.size("near"))).first()[0] <= 3 * graph_index.DEGREE
    assert index.links.count() == e.count()
    recall, share, found = measured(index, e, e.where("vec_id % 100 = 0"), 10, "vec_id", beam=24)
    assert recall >= 0.9
    # these vectors have no structure; see the next test for some that have
    assert share <= 0.4
    assert all(r.query_id != r.neighbor_id for r in found)


def test_vectors_with_structure_need_few_comparisons(spark, tmp_path):
    rng = np.random.default_rng(3)
    # points of a plane, bent into 24 dimensions
    flat = rng.uniform(-1, 1, (4000, 2))
    m = np.sin(flat @ rng.normal(size=(2, 24)) + rng.uniform(0, 6, 24))
    corpus = spark.createDataFrame(rows_of(m), ROWS)
    path = str(tmp_path / "index")
    index = graph_index.build_graph(corpus, path=path)
    queries = corpus.where("id % 100 = 0")
    recall, share, found = measured(index, corpus, queries, 10)
    assert recall >= 0.9
    assert share <= 0.2
    again, _, same = measured(graph_index.GraphIndex.open(spark, path), corpus, queries, 10)
    assert again == recall
    assert sorted(map(tuple, same)) == sorted(map(tuple, found))


def test_a_wide_beam_gives_the_exact_result(spark):
    rng = np.random.default_rng(5)
    corpus = spark.createDataFrame(rows_of(rng.normal(size=(300, 8))), ROWS)
    index = graph_index.build_graph(corpus)
    found, walked = graph_index.search_graph(index, corpus, 5, beam=300)
    key = lambda r: (r.query_id, r["rank"])
    assert [tuple(r) for r in sorted(found.collect(), key=key)] == [tuple(r) for r in sorted(neighbors.knn(corpus, corpus, 5).collect(), key=key)]
    assert walked.count() == 300


def test_copies_share_a_node(spark):
    rng = np.random.default_rng(8)
    # a third of all rows is one vector
    rows = rows_of(rng.normal(size=(400, 6))) + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(200)]
    corpus = spark.createDataFrame(rows, ROWS).repartition(5)
    index = graph_index.build_graph(corpus)
    assert index.nodes.count() == 401
    found, _ = graph_index.search_graph(index, corpus.where("id IN (1000, 1150, 7)"), 12, beam=64)
    got = {q: [r.neighbor_id for r in sorted(found.where(F.col("query_id") == q).collect(), key=lambda r: r["rank"])] for q in (1000, 1150)}
    assert got == {1000: list(range(1001, 1013)), 1150: list(range(1000, 1012))}
    with pytest.raises(ValueError, match="fewer than"):
        graph_index.search_graph(index, corpus, graph_index.COPIES)


def test_odd_rows_and_tables(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 0.0]), (6, [0.0, 1.0]), (6, [0.0, 1.0]), (7, [1.0, 0.1])]
    corpus = spark.createDataFrame(odd, ROWS)
    index = graph_index.build_graph(corpus)
    queries = spark.createDataFrame([(9, [1.0, 0.0]), (10, [0.0, 2.0]), (11, None)], ROWS)
    found, walked = graph_index.search_graph(index, queries, 5)
    got = sorted((r.query_id, r["rank"], r.neighbor_id, r.similarity) for r in found.collect())
    # both vectors of the repeated id are found; the id is listed once, by its nearer one
    assert got == [(9, 1, 6, 1.0), (9, 2, 7, 0.995037), (10, 1, 6, 1.0), (10, 2, 7, 0.099504)]
    assert {r.query_id for r in walked.collect()} == {9, 10}
    for n in (0, 1):
        index = graph_index.build_graph(corpus.where("id = 7").limit(n))
        found, _ = graph_index.search_graph(index, queries, 5)
        assert found.count() == 2 * n
        assert graph_index.search_graph(index, corpus.where("id = 7").limit(n), 5)[0].count() == 0
