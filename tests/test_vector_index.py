"""The saved index of buckets finds what an exact search finds, for fewer comparisons where vectors cluster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import retrieval, vector_index


def table(spark, x, extra=()):
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id long, v array<float>").repartition(3)


def recall(got, want):
    have = {(r.query_id, r.id) for r in got}
    return sum((r.query_id, r.id) in have for r in want) / len(want)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_and_comparisons(spark, tmp_path, clustered):
    rng = np.random.default_rng(5)
    n, dims = 6000, 32
    x = unit(rng.standard_normal((60, dims))[rng.integers(60, size=n)] * 3 + rng.standard_normal((n, dims)) * 0.5) if clustered else unit(rng.standard_normal((n, dims)))
    folder = f"file://{tmp_path}/index"
    chunks = table(spark, x, [(n, None), (n + 1, [float("nan")] * dims), (n + 2, [1.0])])
    assert vector_index.build(chunks, folder, k=10) == 1
    queries = chunks.filter("id % 100 = 0 AND id < 6000").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = vector_index.nearest(queries, folder, 10).collect()
    want = retrieval.nearest(queries, chunks.filter("id < 6000"), 10).select("query_id", "id", "score", "rank").collect()
    assert recall(got, want) >= 0.9
    exact = {(r.query_id, r.id): r.score for r in want}
    assert all(abs(r.score - exact.get((r.query_id, r.id), r.score)) < 1e-9 for r in got)
    compared = vector_index.candidates(queries, folder).agg(F.avg("compared")).first()[0] / 4
    assert not clustered or compared < 0.2 * n
    # All buckets probed: an exact search.
    every = vector_index.nearest(queries, folder, 10, probes=1 << 12).collect()
    assert recall(every, want) == 1.0 and len(every) == len(want)


def test_hot_bucket_is_dealt_over_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 50)
    x = np.vstack([np.tile([1.0, 0.0, 0.0, 0.0], (400, 1)), unit(np.random.default_rng(1).standard_normal((50, 4)))])
    folder = f"file://{tmp_path}/index"
    vector_index.build(table(spark, x), folder, k=5)
    queries = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query_id long, q array<float>")
    assert [(r.rank, r.id) for r in vector_index.nearest(queries, folder, 5).orderBy("rank").collect()] == [(k + 1, k) for k in range(5)]


def test_empty_and_missing(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    queries = spark.createDataFrame([(0, [1.0]), (1, None)], "query_id long, q array<float>")
    with pytest.raises(ValueError):
        vector_index.nearest(queries, folder)
    vector_index.build(table(spark, np.zeros((0, 1))), folder)
    assert vector_index.nearest(queries, folder).count() == 0
    vector_index.build(table(spark, np.ones((1, 1))), folder)
    assert [(r.query_id, r.id) for r in vector_index.nearest(queries, folder).collect()] == [(0, 0)]


def test_recall_on_the_given_table(spark):
    from parlance.plans import catalog

    d = "/root/testdata/sf0.001"
    got = catalog.QUERIES["vector_index_neighbours"](spark, d).collect()
    want = catalog.QUERIES["vector_index_all_probes"](spark, d).collect()
    assert recall(got, want) >= 0.9


def test_search_of_texts_by_the_index(spark, tmp_path):
    from parlance.sources import adapters

    embed = lambda df: adapters.embed(df, adapters.hashing_embedder(64), text="query" if "query" in df.columns else "text")
    texts = spark.createDataFrame([(k, f"passage about topic{k % 10} number{k}", f"s{k % 3}") for k in range(300)], "id long, text string, source string")
    chunks, folder = embed(texts), f"file://{tmp_path}/index"
    vector_index.build(chunks, folder, k=4)
    queries = spark.createDataFrame([(1, "number7 about topic7"), (2, " ")], "query_id long, query string")
    exact = retrieval.search(queries, chunks, embed).collect()
    got = retrieval.search(queries, chunks, embed, index=folder).collect()
    assert {r.query_id for r in got} == {1} and set(got[0].asDict()) == set(exact[0].asDict())
    assert next(r for r in got if r["rank"] == 1).id == next(r for r in exact if r["rank"] == 1).id
