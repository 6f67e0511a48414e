"""Nearest neighbours over pivot cells (J-14, J-16) equal a full comparison."""

import numpy as np
import pytest

from tessera.operators import knn as K


def full(keys, queries, k, metric):
    out = []
    for q, qv in queries:
        s = K._scores(np.array([qv]), np.array([v for _, v in keys]), metric)[0]
        order = sorted(range(len(keys)), key=lambda i: (-s[i], keys[i][0]))[:k]
        out += [(q, keys[i][0], r + 1) for r, i in enumerate(order)]
    return sorted(out)


def clusters(n, dim, centres, rng, spread=0.05):
    c = rng.normal(size=(centres, dim)) * 4
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * spread


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_cells_give_the_full_comparison(spark, metric):
    rng = np.random.default_rng(5)
    keys = [(i, v.tolist()) for i, v in enumerate(clusters(400, 6, 12, rng))] + [(1000 + i, [1.0] * 6) for i in range(90)] + [(2000, [0.0] * 6)]
    queries = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(25, 6)) * 3)] + [(50, [1.0] * 6), (51, [0.0] * 6)]
    kdf = spark.createDataFrame(keys, "id long, vec array<double>").repartition(3)
    qdf = spark.createDataFrame(queries, "id long, vec array<double>")
    got = sorted((r.qid, r.kid, r["rank"]) for r in K.knn(kdf, qdf, 7, metric, cell_rows=40).collect())
    assert got == full(keys, queries, 7, metric)


def test_few_copies_of_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    x = clusters(1500, 8, 40, rng)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    one = df.selectExpr("0 AS head", "id", "vec")
    placed, cells = K.cells_of(one, "l2", 60)
    many = len(cells.figures)
    assert many >= 60 and placed.count() == 1500                       # keys are not copied
    kth = K.knn(df, df, 3, "l2", cell_rows=60).groupBy("qid").agg({"score": "min"}).toDF("id", "kth")
    more = K.routed(one.join(kth, "id").select("head", "id", "vec", "kth"), cells, 3).count()
    first = K.routed(one, cells, 3).count()
    assert (first + more) / 1500 < many / 5                            # copies of a query, far below the number of cells


def test_heads_and_short_tables(spark):
    rng = np.random.default_rng(9)
    keys = [(h, i, rng.normal(size=3).tolist()) for h in range(3) for i in range(50 if h else 2)]
    queries = [(h, i, rng.normal(size=3).tolist()) for h in range(4) for i in range(5)]
    schema = "head int, id long, vec array<double>"
    got = sorted((r.head, r.qid, r.kid, r["rank"]) for r in K.knn_heads(spark.createDataFrame(keys, schema), spark.createDataFrame(queries, schema), 4, 4, "dot", cell_rows=10).collect())
    want = sorted((h, *r) for h in range(3) for r in full([(i, v) for g, i, v in keys if g == h], [(i, v) for g, i, v in queries if g == h], 4, "dot"))
    assert got == want
    none = spark.createDataFrame([], "id long, vec array<double>")
    some = spark.createDataFrame([(1, [1.0])], "id long, vec array<double>")
    assert K.knn(none, some).collect() == [] and K.knn(some, none).collect() == []


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_slabs_and_blocks_give_the_full_comparison(spark, metric, monkeypatch):
    monkeypatch.setattr(K, "SLAB", 30)
    monkeypatch.setattr(K, "QUERIES", 12)
    monkeypatch.setattr(K, "SLICE", 200)
    rng = np.random.default_rng(6)
    keys = [(i, v.tolist()) for i, v in enumerate(clusters(200, 5, 9, rng))] + [(1000 + i, [1.0] * 5) for i in range(90)] + [(3000 + i, rng.normal(size=5).tolist()) for i in range(100)]
    queries = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 5)) * 3)] + [(50, [1.0] * 5), (51, [0.0] * 5)]
    kdf = spark.createDataFrame(keys, "id long, vec array<double>").repartition(3)
    qdf = spark.createDataFrame(queries, "id long, vec array<double>")
    got = sorted((r.qid, r.kid, r["rank"]) for r in K.knn(kdf, qdf, 7, metric, cell_rows=10).collect())
    assert got == full(keys, queries, 7, metric)


def test_copies_of_spread_vectors_follow_slabs_not_cells(spark, monkeypatch):
    monkeypatch.setattr(K, "SLAB", 500)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 16)))], "id long, vec array<double>")
    one = df.selectExpr("0 AS head", "id", "vec")
    _, cells = K.cells_of(one, "l2", 20)
    assert len(cells.figures) > 300
    kth = K.knn(df, df, 3, "l2", cell_rows=20).groupBy("qid").agg({"score": "min"}).toDF("id", "kth")
    copies = K.routed(one, cells, 3).count() + K.routed(one.join(kth, "id").select("head", "id", "vec", "kth"), cells, 3).count()
    assert copies <= 2000 * 6                                          # nothing can be excluded: 300 times as many by cells
