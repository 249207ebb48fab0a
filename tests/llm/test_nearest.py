"""The kd-tree's search against brute force, and where the chi-square test stops it."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import nearest


def clustered(n, dims=32, clusters=60, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    x = centres[rng.integers(clusters, size=n)] + 0.1 * rng.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def brute(x, queries, k):
    x = x.astype(float)
    for q in queries:
        score = x @ x[q]
        score[q] = -np.inf
        yield q, np.lexsort((np.arange(len(x)), -score))[:k]


def test_search_stops_early_on_clusters():
    x = clustered(16_000).astype(float)
    matrix = np.random.default_rng(nearest.SEED).normal(size=(x.shape[1], nearest.PROJECTED))
    points = x @ matrix
    tree = nearest.Leaves(np.arange(len(x)), x, points, nearest.leaves_of(points))
    asked = np.arange(0, len(x), 20)
    who, row, _ = nearest.search(tree, asked, x[asked], points[asked], np.full(len(asked), -np.inf), 1.0 + 1e-9, 20)
    got = defaultdict(set)
    for w, r in zip(who, row):
        got[int(asked[w])].add(int(tree.ids[r]))
    hits = sum(len(got[int(q)] & set(best.tolist())) for q, best in brute(x, asked, 20))
    assert hits >= 0.9 * 20 * len(asked)
    assert tree.verified <= 0.5 * len(asked) * len(tree.start)


@pytest.mark.parametrize("spread_out", [False, True])
def test_recall_over_many_blocks(spark, monkeypatch, spread_out):
    monkeypatch.setattr(nearest, "BLOCK", 2048)
    monkeypatch.setattr(nearest, "QUERIES", 300)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 32)).astype(np.float32) if spread_out else clustered(20_000)
    x[5000:9000] = x[5000]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = nearest.nearest(df, F.col("vec_id") % 100 == 0, 20).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r)
    hits = total = 0
    for q, best in brute(x, range(0, 20_000, 100), 20):
        found = got[q]
        assert [r.rank for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found) and q not in {r.vec_id for r in found}
        assert all(abs(r.score - x[r.vec_id].astype(float) @ x[q].astype(float)) < 1e-9 * max(1, abs(r.score)) for r in found)
        hits, total = hits + len({r.vec_id for r in found} & set(best.tolist())), total + 20
    assert hits >= 0.9 * total


def test_odd_tables(spark):
    df = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e200, 1e200]), (0, [0.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank, r.vec_id) for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, 2).collect()}
    assert {(20, 1, 1), (20, 2, 0)} <= got
    none = nearest.nearest(df.filter("false"), F.col("vec_id") % 20 == 0)
    assert none.columns == ["query_id", "rank", "vec_id", "score"] == nearest.nearest(df, F.lit(True)).columns and none.count() == 0


def test_rows_alike_are_as_many_candidates(spark):
    """Every row but the query's own is a candidate, those alike in id and vector too; many of a kind move as one row."""
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (20, [0.4, 0.0]), (3, [0.1, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = [(r.rank, r.vec_id, r.score) for r in nearest.nearest(df.filter("not (vec_id = 20 and embedding[0] < 1)"), F.col("vec_id") == 20, 9).orderBy("rank").collect()]
    assert got == [(1, 20, 1.0), (2, 1, 0.5), (3, 1, 0.5), (4, 3, 0.1)]
    assert nearest.nearest(df, F.col("vec_id") == 3, 9).count() == 5
    many = df.unionByName(spark.range(5000).selectExpr("7L AS vec_id", "array(0.9D, 0D) AS embedding"))
    got = [(r.rank, r.vec_id) for r in nearest.nearest(many, F.col("vec_id") == 7, 20).orderBy("rank").collect()]
    assert got == [(1, 20), (2, 20), *[(k, 7) for k in range(3, 21)]]
