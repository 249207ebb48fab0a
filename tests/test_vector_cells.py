"""What moves to the saved index's cells doesn't grow with the buckets that are looked into."""

import numpy as np
from pyspark.sql import functions as F

from parlance.operators import vector_index


def moved(spark, df):
    """Rows and result: records that the shuffles of ``df`` write, and its rows."""
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    stages = lambda: store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    total = lambda: sum(x.shuffleWriteRecords() for x in (stages().apply(k) for k in range(stages().size())))
    before, rows = total(), df.collect()
    spark._jvm.java.lang.Thread.sleep(1000)
    return total() - before, rows


def test_queries_move_once_for_each_cell(spark, tmp_path):
    """All 32 buckets of 4 tables: a query and what it finds move once for each cell of one table, and the result is exact."""
    x = np.random.default_rng(3).standard_normal((6000, 8)).astype(np.float32)
    chunks = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<float>")
    folder, k = f"file://{tmp_path}/index", 3
    vector_index.build(chunks, folder, k=k)
    queries = chunks.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    n, rows = moved(spark, vector_index.nearest(queries, folder, k, probes=1 << 12))
    assert n < 6000 + 300 * 4 * (2 + 2 * k)
    want = x[::20].astype(float) @ x.astype(float).T
    for q in range(300):
        got = [r.id for r in sorted((r for r in rows if r.query_id == 20 * q), key=lambda r: r["rank"])]
        assert got == np.argsort(-want[q], kind="stable")[:k].tolist()


def test_lists_of_buckets_keep_to_their_buckets(spark, tmp_path, monkeypatch):
    """With few probes a query meets the vectors of its buckets alone, however cells are packed and blocks dealt."""
    x = np.random.default_rng(4).standard_normal((3000, 6)).astype(np.float32)
    chunks = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<float>")
    folder = f"file://{tmp_path}/index"
    vector_index.build(chunks, folder, k=5)
    queries = chunks.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    plan, stored, _ = vector_index.opened(spark, folder)
    met = vector_index.probed(queries, plan, 2).join(stored, ["table", "bucket"]).select("query_id", "id").distinct().collect()
    score = x.astype(float) @ x.astype(float).T
    want = {}
    for r in met:
        want.setdefault(r.query_id, []).append((-score[r.query_id, r.id], r.id))
    want = {q: [i for _, i in sorted(found)[:5]] for q, found in want.items()}
    for part, queries_at_once in ((50_000, 20_000), (200, 7)):
        monkeypatch.setattr(vector_index, "PART", part)
        monkeypatch.setattr(vector_index, "MOST_QUERIES", queries_at_once)
        got = {}
        for r in vector_index.nearest(queries, folder, 5, probes=2).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want
