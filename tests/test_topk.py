"""The search by blocks gives what comparing each pair gives, odd vectors and copies included."""

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.operators import retrieval

NAN, INF = float("nan"), float("inf")


def told(found):
    return sorted((r.query_id, r["rank"], r.id, r.label, str(r.score)) for r in found.collect())


def plain(queries, chunks, k):
    scored = chunks.join(F.broadcast(queries)).withColumn("score", retrieval.dot(F.col("q"), F.col("v")))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def test_search_by_blocks_is_exact(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 20)
    monkeypatch.setattr(retrieval, "PART", 60)
    rng = np.random.default_rng(2)
    some = rng.standard_normal((40, 6)).round(1)
    # Each vector several times, so that ranks end within copies, and odd ones among them.
    rows = [(int(i), i % 5, [float(x) for x in some[i % 40]]) for i in range(200)]
    odd = [None, [], [1.0], [1.0, None, 2.0, 3.0, 4.0, 5.0], [NAN] * 6, [INF, 0.0, 1.0, 1.0, 1.0, 1.0], [-INF] * 6, [0.0] * 6]
    rows += [(1000 + i, 7, v) for i, v in enumerate(odd)] + [(-5, 7, None)]
    chunks = spark.createDataFrame(rows, "id long, label long, v array<double>")
    queries = chunks.filter("id % 3 = 0 OR id >= 1000").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    for k in (3, 12, 300):
        assert told(retrieval.nearest(queries, chunks, k)) == told(plain(queries, chunks, k))


def test_searches_compare_no_pair_by_itself(spark):
    """No join of every query with every chunk: blocks meet in tasks."""
    rows = spark.range(50).select("id", F.array(F.rand(1), F.rand(2)).cast("array<float>").alias("v"))
    plan = retrieval.nearest(rows.select(F.col("id").alias("query_id"), F.col("v").alias("q")), rows)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_halves_round_away_from_zero():
    from parlance.operators.topk import rounded

    assert rounded(np.array([0.5, -0.5, 1.5, 0.25, INF, NAN]), 0).tolist()[:5] == [1, -1, 2, 0, INF]
